"""Column expressions and pluggable text interfaces."""
