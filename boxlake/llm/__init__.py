"""Training-data operators over documents and pages; nothing outside this subpackage imports it."""
