"""Identity of the model that a store's vectors come from. Anything unclear fails closed."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from typing import Any

FIELDS = ("schema_version", "backend", "model", "model_digest", "dimension", "distance", "normalization")
DISTANCES = ("cosine", "ip", "l2")


class IdentityError(ValueError):
    """Metadata that names no model, or more than one."""


def strict_bool(value: Any) -> bool:
    """True and false, as themselves, as 1 and 0, or as these words."""
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) and value in (0, 1):
        return bool(value)
    if isinstance(value, str) and value.strip().lower() in ("true", "1", "false", "0"):
        return value.strip().lower() in ("true", "1")
    raise IdentityError(f"not a boolean: {value!r}")


def strict_int(value: Any) -> int:
    """A whole number; booleans and fractions are none."""
    if isinstance(value, bool):
        raise IdentityError(f"not a number: {value!r}")
    if isinstance(value, float) and not value.is_integer():
        raise IdentityError(f"not whole: {value!r}")
    try:
        return int(value)
    except (TypeError, ValueError) as e:
        raise IdentityError(f"not a number: {value!r}") from e


@dataclass(frozen=True)
class Identity:
    schema_version: int
    backend: str
    model: str
    model_digest: str
    dimension: int
    distance: str
    normalization: bool

    def as_dict(self) -> dict[str, Any]:
        return asdict(self)


def _typed(field: str, value: Any) -> Any:
    if field in ("schema_version", "dimension"):
        return strict_int(value)
    if field == "normalization":
        return strict_bool(value)
    if not isinstance(value, str) or not value.strip():
        raise IdentityError(f"{field} is missing")
    return value.strip()


def parse(meta: dict[str, Any], prefix: str = "") -> Identity:
    """The identity in ``meta``, whose keys may be plain or carry ``prefix``; both forms must agree where both are there."""
    found: dict[str, Any] = {}
    for field in FIELDS:
        values = [_typed(field, meta[k]) for k in dict.fromkeys((field, prefix + field)) if meta.get(k) is not None]
        if not values:
            raise IdentityError(f"{field} is missing")
        if len(set(values)) > 1:
            raise IdentityError(f"{field} has two values: {values}")
        found[field] = values[0]
    if found["dimension"] <= 0 or found["distance"] not in DISTANCES:
        raise IdentityError(f"impossible dimension or distance: {found['dimension']}, {found['distance']}")
    return Identity(**found)


def agree(a: Identity, b: Identity) -> None:
    """Raise unless both name one model, so vectors of different models are never compared."""
    differ = [f for f in FIELDS if getattr(a, f) != getattr(b, f)]
    if differ:
        raise IdentityError("identities differ in " + ", ".join(differ))


def space_of(config: dict[str, Any] | None, meta: dict[str, Any] | None) -> str:
    """The distance of a vector space: its configuration, else its metadata; never a guess."""
    for source in (config or {}, meta or {}, (config or {}).get("hnsw") or {}):
        for key in ("space", "hnsw:space", "distance"):
            if source.get(key):
                if source[key] not in DISTANCES:
                    raise IdentityError(f"unknown space {source[key]!r}")
                return source[key]
    raise IdentityError("the space is not stated")
