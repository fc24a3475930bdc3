"""Column functions: no DataFrame goes in or out."""
