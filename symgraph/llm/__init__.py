"""Training-data operators: ten stand-alone components over document tables.

Nothing else in the library imports this subpackage; it may be removed whole.
"""
