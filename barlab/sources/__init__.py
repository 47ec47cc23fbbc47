"""Reading and writing bars."""
