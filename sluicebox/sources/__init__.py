"""Reading messy files into tables and writing tables out."""
