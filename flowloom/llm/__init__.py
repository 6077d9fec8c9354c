"""Operators for preparing training data; `flowloom.llm.catalog` registers their queries."""
