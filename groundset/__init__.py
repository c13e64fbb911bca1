"""Evidence-backed dataset building as PySpark DataFrame operators."""

from groundset.spec import FieldSpec, TaskSpec

__all__ = ["FieldSpec", "TaskSpec"]
__version__ = "0.1.0"
