"""Operators over facts: recursive rules, entity shaping and transactions."""

from .pull import Spec, everything, in_order, pull
from .rules import Defined, evaluate
from .transact import TransactError, Transacted, transact

__all__ = ["Defined", "Spec", "TransactError", "Transacted", "evaluate", "everything", "in_order", "pull", "transact"]
