"""Find look-alike images, or any items described by a vector and a bag of
hash tokens, with Spark DataFrame jobs."""

from .config import Config

__all__ = ["Config"]
