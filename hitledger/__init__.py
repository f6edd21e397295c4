"""hitledger: access-log analytics as plain DataFrame -> DataFrame functions."""

from hitledger.functions.predicates import Exclusion, Scope, Service

__all__ = ["Exclusion", "Scope", "Service"]
