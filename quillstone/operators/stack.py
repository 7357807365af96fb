"""Stacks of storage transforms (X4): each is a pair of Column functions, for writing and for reading."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.operators import codec

Transform = Callable[[Column], Column]


@dataclass(frozen=True)
class Layer:
    """One transform of a stack; ``read`` undoes ``write``."""

    name: str
    write: Transform
    read: Transform


def deflate() -> Layer:
    return Layer("deflate", lambda b: codec.compress(b)["data"], lambda b: codec.decompress(F.struct(b.alias("data"))))


def aes(key: Column) -> Layer:
    return Layer("aes", lambda b: codec.encrypt(b, key), lambda b: codec.decrypt(b, key))


class Stack:
    """Layers in the order of writing; reading goes the other way."""

    def __init__(self, *layers: Layer):
        self.layers = layers

    @property
    def name(self) -> str:
        return "+".join(x.name for x in self.layers) or "plain"

    def put(self, blob: Column) -> Column:
        for layer in self.layers:
            blob = layer.write(blob)
        return blob

    def get(self, stored: Column) -> Column:
        for layer in reversed(self.layers):
            stored = layer.read(stored)
        return stored
