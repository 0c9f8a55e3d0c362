"""sigspark: DataFrame operators for collections of short, noisy step signals."""

from .session import ship

__all__ = ["ship"]
