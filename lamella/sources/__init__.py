"""Reading and writing nested records, and what files say of themselves."""
