"""View bundles: a stored view in one archive whose bytes depend on its files alone, verified before it is unpacked.

Archives are for moving a bounded view between hosts; a view too large for one file stays a folder of parquet.
"""

from __future__ import annotations

import hashlib
import json
import os
import zipfile

MANIFEST = "manifest.json"
_EPOCH = (1980, 1, 1, 0, 0, 0)


def _files(folder: str) -> list[str]:
    out = []
    for at, _, names in os.walk(folder):
        out += [os.path.relpath(os.path.join(at, n), folder).replace(os.sep, "/") for n in names]
    return sorted(out)


def _digest(stream) -> tuple[str, int]:
    h, size = hashlib.sha256(), 0
    while part := stream.read(1 << 20):
        h.update(part)
        size += len(part)
    return h.hexdigest(), size


def pack(folder: str, bundle: str, **about: str) -> str:
    """Write a folder's files, in order of their names, with a manifest of their digests; the bundle's own digest is returned."""
    listed = {}
    for name in _files(folder):
        with open(os.path.join(folder, name), "rb") as f:
            listed[name] = dict(zip(("sha256", "size"), _digest(f)))
    aside = f"{bundle}.part"
    with zipfile.ZipFile(aside, "w", zipfile.ZIP_STORED) as z:
        z.writestr(zipfile.ZipInfo(MANIFEST, _EPOCH), json.dumps({"about": about, "files": listed}, sort_keys=True, separators=(",", ":")))
        for name in listed:
            with open(os.path.join(folder, name), "rb") as f, z.open(zipfile.ZipInfo(f"files/{name}", _EPOCH), "w", force_zip64=True) as out:
                while part := f.read(1 << 20):
                    out.write(part)
    os.replace(aside, bundle)
    with open(bundle, "rb") as f:
        return _digest(f)[0]


def verify(bundle: str, digest: str | None = None) -> dict:
    """The manifest of a bundle whose files are those it lists; anything else raises."""
    if digest is not None:
        with open(bundle, "rb") as f:
            if _digest(f)[0] != digest:
                raise ValueError("the bundle is not the one expected")
    with zipfile.ZipFile(bundle) as z:
        manifest = json.loads(z.read(MANIFEST))
        names = sorted(n.removeprefix("files/") for n in z.namelist() if n != MANIFEST)
        if names != sorted(manifest["files"]):
            raise ValueError("the bundle's files are not those of its manifest")
        for name, want in manifest["files"].items():
            if name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"unsafe path {name}")
            try:
                with z.open(f"files/{name}") as f:
                    sound = _digest(f) == (want["sha256"], want["size"])
            except zipfile.BadZipFile:
                sound = False
            if not sound:
                raise ValueError(f"{name} is damaged")
    return manifest


def unpack(bundle: str, folder: str, digest: str | None = None) -> dict:
    """Verify, write the files aside, and rename them into place; the folder must not be there yet."""
    manifest = verify(bundle, digest)
    if os.path.exists(folder):
        raise FileExistsError(folder)
    aside = f"{folder}.part"
    with zipfile.ZipFile(bundle) as z:
        for name in manifest["files"]:
            target = os.path.join(aside, name)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with z.open(f"files/{name}") as f, open(target, "wb") as out:
                while part := f.read(1 << 20):
                    out.write(part)
    os.makedirs(aside, exist_ok=True)
    os.rename(aside, folder)
    return manifest
