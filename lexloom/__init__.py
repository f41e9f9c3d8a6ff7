"""lexloom: multilingual text retrieval and question answering on Spark DataFrames."""

from .config import Config
from .errors import LexloomError

__all__ = ["Config", "Engine", "LexloomError"]
__version__ = "0.1.0"


def __getattr__(name: str):  # noqa: ANN202
    if name == "Engine":
        from .plans.engine import Engine

        return Engine
    raise AttributeError(name)
