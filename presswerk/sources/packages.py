"""Prompt packages and feed lists in YAML or JSON files, read on the driver.

A YAML library is used if it is there; without one, files must be JSON, which is YAML too.
"""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from presswerk import schema

PROMPT_KEYS = ("batch_system", "batch_user_template", "meta_system", "meta_user_template", "super_meta_system", "super_meta_user_template")


def parse(text: str):
    try:
        import yaml
    except ImportError:
        return json.loads(text) if text.strip() else None
    return yaml.safe_load(text)


def read_mapping(path: str | os.PathLike) -> dict:
    """Missing files raise FileNotFoundError, other things than a mapping ValueError."""
    got = parse(Path(path).read_text(encoding="utf-8"))
    if not isinstance(got, dict):
        raise ValueError(f"{path} does not hold a mapping")
    return got


def merged(base: dict, over: dict) -> dict:
    """``over`` wins; mappings are merged level by level."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def resolve(path: str | os.PathLike, seen: tuple[Path, ...] = ()) -> dict:
    """A prompt file over what it includes; later includes win over earlier ones, a cycle raises ValueError."""
    p = Path(path).resolve()
    if p in seen:
        raise ValueError("include cycle: " + " -> ".join(x.name for x in (*seen, p)))
    own = read_mapping(p)
    includes = own.pop("include", None) or own.pop("includes", None) or []
    out: dict = {}
    for name in [includes] if isinstance(includes, str) else includes:
        out = merged(out, resolve(p.parent / name, (*seen, p)))
    return merged(out, own)


def package_map(root: str | os.PathLike) -> dict[str, dict]:
    """Packages of a folder by file stem (paths with a part that starts with _ are private), or of one file that lists them."""
    root = Path(os.path.expanduser(os.path.expandvars(str(root))))
    if root.is_file():
        return {k: v for k, v in read_mapping(root).items() if isinstance(v, dict)}
    if not root.is_dir():
        raise FileNotFoundError(root)
    out: dict[str, dict] = {}
    for f in sorted(x for x in root.rglob("*") if x.suffix in (".yaml", ".yml", ".json")):
        if any(part.startswith("_") for part in f.relative_to(root).parts):
            continue
        if f.stem in out:
            raise ValueError(f"two packages are named {f.stem}")
        out[f.stem] = resolve(f)
    return out


def list_packages(root) -> list[str]:
    return sorted(package_map(root))


def load_package(root, name: str) -> dict:
    return package_map(root)[name]


def _inline(prompts: dict) -> dict[str, str]:
    return {k: v for k, v in prompts.items() if isinstance(v, str) and (k.endswith("_system") or k.endswith("_template"))}


def package_name(config: dict, package: str | None = None) -> str:
    """The package that ``select_prompts`` takes: asked for, selected or default, else the first by name; the selected name if prompts are embedded."""
    own = config.get("prompts") or {}
    asked = [x for x in (package, own.get("selected"), own.get("default_package"), "default") if x]
    if _inline(own) or not own:
        return str(own.get("selected") or "")
    packages = package_map(own.get("path") or "config/prompts")
    return next((x for x in asked if x in packages), min(packages, default=""))


def select_prompts(config: dict, package: str | None = None) -> dict[str, str]:
    """Prompts embedded in the config, else those of its package; none if the config says nothing of prompts."""
    own = config.get("prompts") or {}
    if _inline(own) or not own:
        return _inline(own)
    name = package_name(config, package)
    return {k: str(v) for k, v in load_package(own.get("path") or "config/prompts", name).items()} if name else {}


def save_package(root: str | os.PathLike, name: str, prompts: dict) -> Path:
    """Writes a package as JSON; the name may hold no separator and not start with _, the root must be a folder."""
    name, root = (name or "").strip(), Path(root)
    if not name or name.startswith("_") or any(c in name for c in "/\\") or name in (".", ".."):
        raise ValueError(f"{name!r} is no package name")
    if root.is_file():
        raise ValueError("packages in one file cannot be written to")
    root.mkdir(parents=True, exist_ok=True)
    target, draft = root / f"{name}.yaml", root / f".{name}.tmp"
    draft.write_text(json.dumps(prompts, ensure_ascii=False, indent=2), encoding="utf-8")
    draft.replace(target)
    return target


def promptset_of(summary_prompts: dict | None) -> dict[str, str]:
    return {k: str((summary_prompts or {}).get(k) or "") for k in PROMPT_KEYS}


def with_promptset(config: dict, prompts: dict[str, str]) -> dict:
    """A copy of the config with the prompts embedded and marked as tried out."""
    return config | {"prompts": {k: prompts.get(k, "") for k in PROMPT_KEYS} | {"selected": "promptlab_inline"}}


def feeds_of(config: dict, base: str | os.PathLike = ".") -> list[dict]:
    """The config's own list of feeds, else that of a file (feeds.path, feeds_path, config/feeds.yaml)."""
    own = config.get("feeds")
    if isinstance(own, list):
        return own
    path = Path(os.path.expanduser(os.path.expandvars(str((own or {}).get("path") or config.get("feeds_path") or "config/feeds.yaml"))))
    got = parse((path if path.is_absolute() else Path(base) / path).read_text(encoding="utf-8"))
    got = got.get("feeds") if isinstance(got, dict) else got
    if not isinstance(got, list) or not all(isinstance(x, dict) for x in got):
        raise ValueError("feeds must be a list of mappings")
    return got


def _strings(v) -> list[str]:
    return [str(x).strip() for x in v if str(x).strip()] if isinstance(v, list) else [v.strip()] if isinstance(v, str) and v.strip() else []


def feed_frame(spark: SparkSession, feeds: list[dict]) -> DataFrame:
    """Feeds as rows; of feeds with one name the last is used."""
    rows = {}
    for f in feeds:
        name = str(f.get("name") or f.get("title") or f.get("label") or "").strip()
        if name:
            rows[name] = (name, str(f.get("url") or ""), _strings(f.get("topics")) or _strings(f.get("topic")), _strings(f.get("category_include") or f.get("categories_include")), _strings(f.get("category_exclude") or f.get("categories_exclude")))
    return spark.createDataFrame(list(rows.values()), schema.ddl(schema.FEEDS))
