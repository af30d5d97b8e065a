"""Column expressions: pure, codegen-friendly, no Python per row."""
