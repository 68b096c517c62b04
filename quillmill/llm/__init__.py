"""Training-data operators. Nothing else in quillmill imports this subpackage."""
