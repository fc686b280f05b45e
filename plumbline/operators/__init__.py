"""Table operators; every one is a function from DataFrame to DataFrame."""
