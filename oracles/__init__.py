"""DuckDB SQL for the registered queries; the library does not use it."""
