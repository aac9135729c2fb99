"""Part of the quill engine."""
