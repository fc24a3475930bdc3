"""Reading and writing tables and landed JSON."""
