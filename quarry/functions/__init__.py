"""Column functions: text, versions, vectors, classifiers."""
