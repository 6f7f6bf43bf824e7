CREATE TABLE invoices (id INT);
