"""The query catalogue with equivalent SQL."""
