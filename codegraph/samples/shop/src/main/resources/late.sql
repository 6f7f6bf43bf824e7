CREATE TABLE SHOP_ORDERS (id INT);
CREATE TABLE shop_late (id INT);
