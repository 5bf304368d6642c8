"""The queries of this subpackage."""

from attestra.plans.registry import Registry

LLM = Registry()
