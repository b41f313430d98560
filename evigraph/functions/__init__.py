"""Column functions; every one returns a ``Column`` unless it says otherwise."""
