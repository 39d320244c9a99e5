"""Named queries with their SQL twins, and the command language."""
