"""Search text to plan: grammar, schema and compiler."""
