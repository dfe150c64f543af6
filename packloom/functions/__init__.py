"""Part of packloom; see README.md."""
