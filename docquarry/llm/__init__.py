"""Training-data operators (ten of them); nothing else in docquarry imports this subpackage."""
