"""Named query plans and their SQL counterparts."""
