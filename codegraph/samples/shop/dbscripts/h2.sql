CREATE TABLE IF NOT EXISTS app.shop_orders (id INT);
create table `shop_items` (id INT);
