"""DataFrame -> DataFrame operators. Column roles are keyword arguments."""
