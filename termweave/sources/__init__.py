"""Where term tables come from, and adapters for other libraries' objects."""
