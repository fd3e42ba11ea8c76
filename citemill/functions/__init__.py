"""Column -> Column expression builders."""
