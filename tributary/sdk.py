"""Declarations for pipeline code: decorators that only record, and never get in the way."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

ATTRIBUTE = "__declared_lineage__"


@dataclass(frozen=True)
class Dataset:
    """A dataset of four parts."""

    service: str
    database: str
    schema: str
    table: str

    @property
    def fqn(self) -> str:
        return ".".join((self.service, self.database, self.schema, self.table))

    def __str__(self) -> str:
        return self.fqn


@dataclass(frozen=True)
class Declaration:
    name: str
    inputs: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ()
    dag: str | None = None
    engine: str | None = None
    sql: str | None = None
    description: str | None = None
    transform: str | None = None
    column_map: tuple = field(default=())
    copy: tuple[str, ...] = ()


registry: list[Declaration] = []
config: dict[str, str] = {}


def _names(value) -> tuple[str, ...]:
    """One or many names as strings; None gives none."""
    if value is None:
        return ()
    many = [value] if isinstance(value, (str, Dataset)) else list(value)
    return tuple(str(v) for v in many if v is not None)


def configure(service: str | None = None, database: str | None = None, schema: str | None = None, dag: str | None = None) -> None:
    """Defaults of the module, for bare dataset names and tasks without a DAG."""
    config.update({k: v for k, v in (("service", service), ("database", database), ("schema", schema), ("dag", dag)) if v is not None})


def task(function: Callable | None = None, *, inputs=None, outputs=None, dag=None, engine=None, sql=None, description=None, transform=None, column_map=None, copy=None, name=None):
    """Records a task; the function stays as it is. Works bare and called."""

    def mark(f: Callable) -> Callable:
        registry.append(Declaration(name or f.__name__, _names(inputs), _names(outputs), dag, engine, sql, description, transform, tuple(column_map or ()), _names(copy)))
        return f

    return mark(function) if function is not None else mark


def sql(query: str, **options):
    """A task that runs a query."""
    return task(engine="sql", sql=query, **options)


def lineage(function: Callable | None = None, *, inputs=None, outputs=None, name=None, description=None, **_):
    """Attaches a fresh dict to the function; never raises."""

    def mark(f: Callable) -> Callable:
        try:
            setattr(f, ATTRIBUTE, {"name": name or getattr(f, "__name__", None), "inputs": list(_names(inputs)), "outputs": list(_names(outputs)), "description": description})
        except Exception:  # an object that takes no attributes
            pass
        return f

    return mark(function) if function is not None else mark
