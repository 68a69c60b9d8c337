"""The registered queries over the star tables."""

from sondera.plans import registry

registry.load(*registry.MODULES)
