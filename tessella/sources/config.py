"""YAML configuration on the driver: ${NAME} is the environment's value, wherever a string has it."""

from __future__ import annotations

import os
import string
from collections.abc import Mapping


class _Braced(string.Template):
    """Only ${NAME} is a name; a lone $ stands for itself."""

    flags = 0
    pattern = r"\$(?:(?P<escaped>(?!))|(?P<named>(?!))|\{(?P<braced>[A-Za-z_]\w*)\}|(?P<invalid>(?!)))"


def _reader(environment: Mapping[str, str]):
    """A YAML loader that fills in names while it builds its strings."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    def text(loader, node):
        try:
            return _Braced(loader.construct_scalar(node)).substitute(environment)
        except KeyError as e:
            raise KeyError(f"not set: {e.args[0]}{node.start_mark}") from None

    Loader.add_constructor("tag:yaml.org,2002:str", text)
    return Loader


def load(path: str, sections: tuple[str, ...] = (), environment: Mapping[str, str] | None = None) -> dict:
    """A configuration file; every section named must be there and be a mapping, clip windows must make sense, and
    relative paths below ``paths`` start from the file's folder."""
    import yaml

    with open(path, encoding="utf-8") as f:
        out = yaml.load(f, _reader(os.environ if environment is None else environment)) or {}
    if not isinstance(out, Mapping):
        raise ValueError("the configuration must be a mapping")
    for s in sections:
        if not isinstance(out.get(s), Mapping):
            raise ValueError(f"section {s} is missing")
    for name, least in (("clip_length", 2), ("clip_stride", 1)):
        value = (out.get("video") or {}).get(name, least)
        if not isinstance(value, int) or value < least:
            raise ValueError(f"video.{name} must be an integer of at least {least}")
    if isinstance(out.get("paths"), Mapping):
        folder = os.path.dirname(os.path.abspath(path))
        out["paths"] = {k: v if not isinstance(v, str) or "://" in v else os.path.normpath(os.path.join(folder, v)) for k, v in out["paths"].items()}
    return dict(out)
