"""Reading and writing tables, archives and exports."""
