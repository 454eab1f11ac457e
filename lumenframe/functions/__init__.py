"""Pure Column builders: vector algebra, geometry and rounding."""
