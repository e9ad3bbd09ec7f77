"""Archive layouts L1-L6 and their registry."""

from logvault.layouts.base import Layout, Resolver, VariantResolver
from logvault.layouts.layouts import (
    LAYOUTS, DocumentLayout, InferredLayout, JsonStringLayout, MergedLayout, PairwiseLayout,
    StaticDynamicLayout, VariantLayout, get_layout,
)

__all__ = ["Layout", "Resolver", "VariantResolver", "LAYOUTS", "get_layout", "JsonStringLayout",
           "PairwiseLayout", "InferredLayout", "MergedLayout", "StaticDynamicLayout", "VariantLayout", "DocumentLayout"]
