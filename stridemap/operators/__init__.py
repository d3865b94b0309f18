"""DataFrame operators of the walk analytics."""
