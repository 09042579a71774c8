from .log import LogStore

__all__ = ["LogStore"]
