"""Documents that change while they are asked."""
