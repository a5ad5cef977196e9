"""Plan shapes and end-to-end jobs composed from the operators."""
