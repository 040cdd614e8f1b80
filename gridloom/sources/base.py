"""What every storage offers."""

from __future__ import annotations

from abc import ABC, abstractmethod


class TensorNotFound(FileNotFoundError):
    """There is no tensor at this place."""


class Storage(ABC):
    """Verbs on one stored thing. Those a storage cannot do raise ``NotImplementedError``."""

    @abstractmethod
    def store(self, new_data, **options): ...

    @abstractmethod
    def append(self, new_data, **options): ...

    @abstractmethod
    def update(self, new_data, **options): ...

    @abstractmethod
    def upsert(self, new_data, **options): ...

    @abstractmethod
    def drop(self, coords, **options): ...

    @abstractmethod
    def read(self, **options): ...

    @abstractmethod
    def exist(self) -> bool: ...

    @abstractmethod
    def delete(self) -> None: ...
