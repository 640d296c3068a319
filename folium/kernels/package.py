"""The parts of a DOCX package from bytes, with limits: packages come from strangers."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from dataclasses import dataclass, field
from functools import lru_cache
from xml.etree import ElementTree as ET

#: Namespaces and the relationship types of the parts that are read, by their last word.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
V = "{urn:schemas-microsoft-com:vml}"
CT = "{http://schemas.openxmlformats.org/package/2006/content-types}"
PR = "{http://schemas.openxmlformats.org/package/2006/relationships}"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"
ROLES = ("styles", "numbering", "theme", "settings", "footnotes", "header", "footer")
#: Limits against bombs: entries, bytes of one part, bytes of all.
ENTRIES, PART, TOTAL = 10_000, 256 << 20, 1 << 30


class PackageError(ValueError):
    """The bytes are not a package that can be read."""


@dataclass(frozen=True)
class Relationship:
    id: str
    type: str
    target: str
    mode: str | None = None

    @property
    def external(self) -> bool:
        return (self.mode or "").lower() == "external"


@dataclass
class Package:
    main: str
    document: ET.Element
    parts: dict[str, ET.Element] = field(default_factory=dict)  # role (not header/footer) -> root
    headers: dict[str, ET.Element] = field(default_factory=dict)  # path -> root
    footers: dict[str, ET.Element] = field(default_factory=dict)
    rels: dict[str, list[Relationship]] = field(default_factory=dict)  # part path -> its relationships
    media: dict[str, bytes] = field(default_factory=dict)
    types: dict[str, dict[str, str]] = field(default_factory=dict)  # "default" by extension, "override" by part
    shared: set[str] = field(default_factory=set)  # roles of small parts, whose trees other packages may hold

    def rel(self, part: str, rid: str) -> Relationship | None:
        """The first relationship of the part with this id."""
        return next((r for r in self.rels.get(part, []) if r.id == rid), None)

    def media_path(self, part: str, target: str) -> str:
        """Beside the part, or from the root; ".." stays as it is."""
        return target.lstrip("/") if target.startswith("/") else posixpath.join(posixpath.dirname(part), target)


def resolve(base: str, target: str) -> str:
    """A relationship's target as a package path: "." and ".." are followed, "/" starts at the root."""
    if target.startswith("/"):
        return target.lstrip("/")
    steps: list[str] = [s for s in posixpath.dirname(base).split("/") if s]
    for step in target.split("/"):
        if step == "..":
            steps[-1:] = []
        elif step not in ("", "."):
            steps.append(step)
    return "/".join(steps)


def rels_path(part: str) -> str:
    folder, name = posixpath.split(part)
    return posixpath.join(folder, "_rels", name + ".rels")


def xml(data: bytes, name: str = "part") -> ET.Element:
    """Parse XML; document type declarations are refused, since no package needs one and entities can explode."""
    if re.search(rb"<!DOCTYPE|<\x00!\x00D\x00O\x00C", data[:4096]) or b"<!ENTITY" in data:
        raise PackageError(f"{name} declares a document type")
    try:
        return ET.fromstring(data)
    except ET.ParseError as error:
        raise PackageError(f"{name} is not well-formed: {error}") from error


#: Bytes of a part that is kept parsed; parts such as styles are the same in many packages, and nobody changes them.
SMALL = 1 << 15


@lru_cache(maxsize=64)
def _small(data: bytes, name: str) -> ET.Element:
    return xml(data, name)


def shared_xml(data: bytes, name: str) -> ET.Element:
    return _small(data, name) if len(data) <= SMALL else xml(data, name)


def relationships(root: ET.Element) -> list[Relationship]:
    """Rows without an id, type or target are dropped."""
    found = [Relationship(e.get("Id", ""), e.get("Type", ""), e.get("Target", ""), e.get("TargetMode")) for e in root.iter(f"{PR}Relationship")]
    return [r for r in found if r.id and r.type and r.target]


def open_package(data: bytes) -> Package:
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        infos = archive.infolist()
    except (zipfile.BadZipFile, ValueError, OSError) as error:
        raise PackageError(f"not a ZIP archive: {error}") from error
    if len(infos) > ENTRIES or sum(i.file_size for i in infos) > TOTAL or any(i.file_size > PART for i in infos):
        raise PackageError("the package exceeds the limits of size or number of entries")
    names = {i.filename for i in infos}

    def read(name: str) -> bytes | None:
        if name not in names:
            return None
        try:
            return archive.read(name)
        except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError) as error:
            raise PackageError(f"{name} cannot be read: {error}") from error

    needed = {}
    for name in ("[Content_Types].xml", "_rels/.rels"):
        raw = read(name)
        if raw is None:
            raise PackageError(f"{name} is missing")
        needed[name] = shared_xml(raw, name)
    types = needed["[Content_Types].xml"]
    known = {
        "default": {e.get("Extension", "").lower(): e.get("ContentType", "") for e in types.iter(f"{CT}Default")},
        "override": {e.get("PartName", "").lstrip("/"): e.get("ContentType", "") for e in types.iter(f"{CT}Override")},
    }
    root = relationships(needed["_rels/.rels"])
    main = next((resolve("", r.target) for r in root if r.type.endswith("/officeDocument")), None)
    raw = read(main) if main else None
    if raw is None:
        raise PackageError("there is no main document part")
    out = Package(main, xml(raw, main), rels={"": root}, types=known)

    def load_rels(part: str) -> list[Relationship]:
        found = read(rels_path(part))
        out.rels[part] = relationships(shared_xml(found, rels_path(part))) if found is not None else []
        return out.rels[part]

    for rel in load_rels(main):
        role = rel.type.rpartition("/")[2]
        path = resolve(main, rel.target)
        if rel.external or role not in ROLES or (raw := read(path)) is None:
            continue
        part = xml(raw, path) if role in ("header", "footer") else shared_xml(raw, path)  # a reader takes watermarks out of headers
        if role in ("header", "footer"):
            (out.headers if role == "header" else out.footers)[path] = part
            load_rels(path)
        else:
            out.parts.setdefault(role, part)
            if len(raw) <= SMALL:
                out.shared.add(role)
    out.media = {name: read(name) for name in sorted(names) if name.startswith("word/media/") and not name.endswith("/")}
    return out


def child(e: ET.Element | None, name: str, ns: str = W) -> ET.Element | None:
    return None if e is None else e.find(ns + name)


def val(e: ET.Element | None) -> str | None:
    return None if e is None else e.get(f"{W}val")


def toggle(e: ET.Element) -> bool:
    """An on/off element: on unless its value says otherwise."""
    return (val(e) or "").lower() not in ("false", "0", "off")


def digits(text: str | None, signed: bool = False) -> int | None:
    """The number that a string of ASCII digits writes, else None."""
    return int(text) if text and re.fullmatch(r"-?\d+" if signed else r"\d+", text, re.A) else None


def local(e: ET.Element, ns: str = W) -> str:
    """The element's name in the namespace, else ""."""
    return _local(e.tag, ns)


@lru_cache(maxsize=4096)
def _local(tag: object, ns: str) -> str:
    return tag[len(ns) :] if isinstance(tag, str) and tag.startswith(ns) else ""
