"""Training-data operators over document, label and embedding tables.

Nothing outside this subpackage imports it; removing the folder leaves the rest of the library whole.
"""
