"""Training-data operators: ten components and the pipeline over `documents`."""
