"""Relational and graph operators over functions(id, name, file, frame, ...) and calls(src, dst, ...)."""
