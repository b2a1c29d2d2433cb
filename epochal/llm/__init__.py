"""Training-data operators: one module per operator, one registry in ``queries``."""
