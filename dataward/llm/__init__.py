"""Training-data operators: each module holds one operator, `registry` their queries."""
