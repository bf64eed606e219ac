"""Reading and writing documents and taxonomies."""
