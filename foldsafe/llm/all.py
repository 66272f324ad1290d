"""Everything this subpackage registers; importing it fills the registry."""

from foldsafe.llm import queries  # noqa: F401
from foldsafe.llm.registry import REGISTRY

__all__ = ["REGISTRY"]
