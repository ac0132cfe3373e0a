"""What statements do to tables, and the relational operators as a fluent API."""
