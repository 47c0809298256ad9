"""Training-data operators for large document tables; optional, nothing outside this folder imports it."""
