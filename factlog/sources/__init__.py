"""Where facts come from: wide tables, or a log of assertions and retractions."""

from .attributes import Attribute, Cardinality, Registry, ValueType
from .log import FactLog
from .wide import WideTables

__all__ = ["Attribute", "Cardinality", "FactLog", "Registry", "ValueType", "WideTables"]
