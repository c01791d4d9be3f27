"""PDF text by scanning content streams; scanned files go to an OCR engine if there is one."""

from __future__ import annotations

import re
import shutil
import subprocess
import tempfile
import zlib
from pathlib import Path
from typing import Protocol

#: A direct text of fewer bytes counts as scanned; the resolution pages are drawn at.
MIN_TEXT_BYTES, DPI = 80, 200
#: What counts as a stream, a shown string, an array of strings, a string in it, and an escape. A string may hold
#: line breaks and escaped ones. An array holds no bracket but an escaped one, and ends at the first that TJ follows, escaped or
#: not; its pattern says which of the two a backslash is, so that it never backtracks.
_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOWN = re.compile(rb"\(((?:[^()\\]|\\.)*)\)\s*Tj", re.S)
_ARRAY = re.compile(rb"\[((?:[^\[\]\\]|\\(?=\][\t\n\f\r ]*TJ)|\\[\[\]]|\\(?![\[\]]))*)\][\t\n\f\r ]*TJ")
_STRING = re.compile(rb"\(((?:[^()\\]|\\.)*)\)", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{3}|.)", re.S)
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t"}


class OcrEngine(Protocol):
    """Reads the text of an image file."""

    def image_to_text(self, path: str) -> str: ...


class Tesseract:
    """Optical recognition by the program ``tesseract``, which has to be on the path of the executors."""

    def __init__(self, language: str = "eng", program: str = "tesseract", timeout: float = 300.0):
        self.language, self.program, self.timeout = language, program, timeout

    @classmethod
    def available(cls, program: str = "tesseract") -> bool:
        return shutil.which(program) is not None

    def image_to_text(self, path: str) -> str:
        done = subprocess.run([self.program, path, "stdout", "-l", self.language], check=True, capture_output=True, timeout=self.timeout)
        return done.stdout.decode("utf-8", "replace")


def unescape(raw: bytes) -> bytes:
    """Escapes of a string: named ones, three octal digits, and otherwise the character itself."""

    def one(m: re.Match[bytes]) -> bytes:
        x = m.group(1)
        return bytes([int(x, 8) & 255]) if len(x) == 3 else _NAMED.get(x, x)

    return _ESCAPE.sub(one, raw)


def content_streams(data: bytes) -> list[bytes]:
    """Streams that may show text, inflated where they say so; a stream that cannot be inflated is left out."""
    out = []
    for about, body in _STREAM.findall(data):
        if b"/FlateDecode" in about:
            try:
                body = zlib.decompress(body)
            except zlib.error:
                continue
        if (b"BT" in body and b"Tj" in body) or b"TJ" in body:
            out.append(body)
    return out


def shown_text(stream: bytes) -> bytes:
    """Strings shown one by one, then those shown as arrays; the order between the two kinds is not kept."""
    parts = [unescape(s) for s in _SHOWN.findall(stream)]
    parts += [b"".join(unescape(s) for s in _STRING.findall(a)) for a in _ARRAY.findall(stream)]
    return b"".join(p + b" " for p in parts).decode("utf-8", "replace").strip().encode()


def direct_text(data: bytes) -> tuple[str, list[int]]:
    """Text of all pages, and the byte offsets at which pages after the first begin; a page is a stream with text."""
    text, boundaries = b"", []
    for page in filter(None, map(shown_text, content_streams(data))):
        if text:
            text += b"\n\n"
            boundaries.append(len(text))
        text += page
    return text.decode("utf-8", "replace"), boundaries


def page_order(name: str) -> int:
    """The number before .png at the end of a name."""
    m = re.search(r"-(\d+)\.png$", name)
    return int(m.group(1)) if m else 0


def rasterise(path: str, folder: str, dpi: int = DPI) -> list[str]:
    """Draw the pages with the external program ``pdftoppm``; files by page number."""
    subprocess.run(["pdftoppm", "-png", "-r", str(dpi), path, f"{folder}/page"], check=True, capture_output=True)
    return sorted((str(p) for p in Path(folder).glob("*.png")), key=page_order)


def pdf_text(data: bytes, ocr: OcrEngine | None = None) -> tuple[str, list[int]]:
    """Direct text, or that of the drawn pages if it is sparse and OCR is at hand; if OCR fails, the direct text stays."""
    text, boundaries = direct_text(data)
    if ocr is None or len(text.strip().encode()) >= MIN_TEXT_BYTES or not shutil.which("pdftoppm"):
        return text, boundaries
    try:
        with tempfile.TemporaryDirectory() as folder:
            source = Path(folder, "source.pdf")
            source.write_bytes(data)
            pages = [t for t in (ocr.image_to_text(p).strip() for p in rasterise(str(source), folder)) if t]
    except Exception:  # noqa: BLE001  any failure of an outside program means: keep what there is
        return text, boundaries
    out, boundaries = b"", []
    for page in pages:
        if out:
            out += b"\n\n"
            boundaries.append(len(out))
        out += page.encode()
    return out.decode(), boundaries


def image_text(data: bytes, suffix: str, ocr: OcrEngine) -> str:
    """Trimmed text of an image."""
    with tempfile.NamedTemporaryFile(suffix=suffix) as f:
        f.write(data)
        f.flush()
        return ocr.image_to_text(f.name).strip()
