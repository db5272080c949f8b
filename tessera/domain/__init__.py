"""Questions about decoded saves, composed of the domain-neutral operators."""
