"""Part of docquarry."""
