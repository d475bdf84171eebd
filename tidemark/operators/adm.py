"""Broadcast-wave channel beds with audio-definition-model metadata: XML, chunks, and rule checks."""

from __future__ import annotations

import re
import struct
from collections import Counter
from functools import reduce
from xml.etree import ElementTree as ET

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources import containers as c

NS = "urn:ebu:metadata-schema:ebuCore_2016"
KIND, PACK, OBJECT, CONTENT, PROGRAMME = "0001", "AP_00011001", "AO_1001", "ACO_1001", "APR_1001"
#: The grammar of ids by element.
GRAMMAR = {
    "audioProgramme": ("audioProgrammeID", r"APR_[0-9a-fA-F]{4}"),
    "audioContent": ("audioContentID", r"ACO_[0-9a-fA-F]{4}"),
    "audioObject": ("audioObjectID", r"AO_[0-9a-fA-F]{4}"),
    "audioPackFormat": ("audioPackFormatID", r"AP_[0-9a-fA-F]{8}"),
    "audioChannelFormat": ("audioChannelFormatID", r"AC_[0-9a-fA-F]{8}"),
    "audioBlockFormat": ("audioBlockFormatID", r"AB_[0-9a-fA-F]{8}_[0-9a-fA-F]{8}"),
    "audioStreamFormat": ("audioStreamFormatID", r"AS_[0-9a-fA-F]{8}"),
    "audioTrackFormat": ("audioTrackFormatID", r"AT_[0-9a-fA-F]{8}_[0-9a-fA-F]{2}"),
    "audioTrackUID": ("UID", r"ATU_[0-9a-fA-F]{8}"),
}
TIME = re.compile(r"\d\d:\d\d:\d\d\.\d{5,9}")


def ids(index: int) -> dict[str, str]:
    """Ids of the channel of a number from 1."""
    n = f"{KIND}{0x1000 + index:04x}"
    return {"channel": f"AC_{n}", "block": f"AB_{n}_00000001", "stream": f"AS_{n}", "track": f"AT_{n}_01", "uid": f"ATU_{index:08x}"}


def timecode(seconds: float) -> str:
    s = max(0.0, seconds)
    whole = int(s)
    return f"{whole // 3600:02d}:{whole // 60 % 60:02d}:{whole % 60:02d}.{int((s - whole) * 1e9 + 0.5):09d}"


def build(speakers: list[dict], rate: int, bits: int, seconds: float, name: str, lfe_hz: float = 120) -> str:
    """XML of a bed of fixed speakers (speaker_id, adm_label, azimuth_adm, elevation, lfe)."""
    if not 0 < lfe_hz <= 500 or rate <= 0 or not np.isfinite(seconds) or seconds < 0:
        raise ValueError("implausible low-frequency limit, rate or duration")
    end = timecode(seconds)
    root = ET.Element("ebuCoreMain", xmlns=NS)
    fmt = ET.SubElement(ET.SubElement(ET.SubElement(root, "coreMetadata"), "format"), "audioFormatExtended", version="ITU-R_BS.2076-2")

    def add(parent, tag, text=None, **attrs):
        e = ET.SubElement(parent, tag, {k: str(v) for k, v in attrs.items()})
        e.text = text
        return e

    kind = {"typeLabel": KIND, "typeDefinition": "DirectSpeakers"}
    pcm = {"formatLabel": "0001", "formatDefinition": "PCM"}
    add(add(fmt, "audioProgramme", audioProgrammeID=PROGRAMME, audioProgrammeName=name[:64] or "Programme", start=timecode(0), end=end), "audioContentIDRef", CONTENT)
    add(add(fmt, "audioContent", audioContentID=CONTENT, audioContentName="Bed"), "audioObjectIDRef", OBJECT)
    obj = add(fmt, "audioObject", audioObjectID=OBJECT, audioObjectName="Bed", start=timecode(0), duration=end)
    add(obj, "audioPackFormatIDRef", PACK)
    pack = add(fmt, "audioPackFormat", audioPackFormatID=PACK, audioPackFormatName="Bed", **kind)
    for i, s in enumerate(speakers, 1):
        k = ids(i)
        add(obj, "audioTrackUIDRef", k["uid"])
        add(pack, "audioChannelFormatIDRef", k["channel"])
        ch = add(fmt, "audioChannelFormat", audioChannelFormatID=k["channel"], audioChannelFormatName=s["adm_label"], **kind)
        block = add(ch, "audioBlockFormat", audioBlockFormatID=k["block"], rtime=timecode(0), duration=end)
        add(block, "speakerLabel", s["adm_label"])
        for axis, v in (("azimuth", s["azimuth_adm"]), ("elevation", s["elevation"]), ("distance", 1.0)):
            add(block, "position", f"{v:.1f}", coordinate=axis)
        if s["lfe"]:
            add(block, "frequency", f"{lfe_hz:g}", typeDefinition="lowPass")
        st = add(fmt, "audioStreamFormat", audioStreamFormatID=k["stream"], audioStreamFormatName=f"PCM_{s['speaker_id']}", **pcm)
        add(st, "audioChannelFormatIDRef", k["channel"])
        add(st, "audioTrackFormatIDRef", k["track"])
        add(add(fmt, "audioTrackFormat", audioTrackFormatID=k["track"], audioTrackFormatName=f"PCM_{s['speaker_id']}", **pcm), "audioStreamFormatIDRef", k["stream"])
        uid = add(fmt, "audioTrackUID", UID=k["uid"], sampleRate=rate, bitDepth=bits)
        add(uid, "audioTrackFormatIDRef", k["track"])
        add(uid, "audioPackFormatIDRef", PACK)
    ET.indent(root)
    return '<?xml version="1.0" encoding="UTF-8"?>\n' + ET.tostring(root, encoding="unicode")


def chna(n: int) -> bytes:
    """Track numbers and their ids."""
    out = struct.pack("<HH", n, n)
    for i in range(1, n + 1):
        k = ids(i)
        out += struct.pack("<H12s14s11sx", i, k["uid"].encode(), k["track"].encode(), PACK.encode())
    return out


def bext(description: str, loudness: float | None, true_peak: float | None) -> bytes:
    """Version-2 broadcast extension; unmeasured levels are 0x7FFF."""
    level = lambda v: 0x7FFF if v is None or not np.isfinite(v) else int(np.floor(max(-327.68, min(327.66, v)) * 100 + 0.5))
    return struct.pack("<256s32s32s10s8sQH64s5h180s", description.encode("ascii", "replace")[:256], b"", b"", b"1970-01-01", b"00:00:00", 0, 2, b"", level(loudness), 0x7FFF, level(true_peak), 0x7FFF, 0x7FFF, b"")


def write(x: np.ndarray, rate: int, bits: int, speakers: list[dict], name: str, loudness: float | None = None, true_peak: float | None = None) -> bytes:
    """A wave file with chna, axml and bext; its mask is 0, as the metadata say where channels go."""
    if len(speakers) != len(x):
        raise ValueError("as many speakers as channels")
    return c.write_wav(x, rate, bits, 0, True, "auto", _chunks(x.shape[1], rate, bits, speakers, name, loudness, true_peak))


def _chunks(frames: int, rate: int, bits: int, speakers: list[dict], name: str, loudness: float | None, true_peak: float | None) -> list[tuple[str, bytes]]:
    xml = build(speakers, rate, bits, frames / rate, name)
    return [("chna", chna(len(speakers))), ("axml", xml.encode()), ("bext", bext(name, loudness, true_peak))]


def stream(sink, blocks, frames: int, rate: int, bits: int, speakers: list[dict], name: str, loudness: float | None = None, true_peak: float | None = None) -> int:
    """As ``write``, from blocks of samples as they come; bytes written."""
    return c.stream_wav(sink, blocks, len(speakers), frames, rate, bits, 0, _chunks(frames, rate, bits, speakers, name, loudness, true_peak), True)


def validate(xml: str, rate: int | None = None, bits: int | None = None, uids: list[str] | None = None) -> list[tuple[str, str, str, str]]:
    """(severity, rule, id, message) of everything that breaks a rule."""
    out: list[tuple[str, str, str, str]] = []
    bad = lambda rule, ident, message, severity="error": out.append((severity, rule, ident or "", message))
    try:
        root = ET.fromstring(xml)
    except ET.ParseError as e:
        return [("error", "xml", "", str(e))]
    tag = lambda e: e.tag.rpartition("}")[2]
    if not root.tag.startswith("{" + NS[:20]):
        bad("namespace", "", "unknown namespace", "warning")
    found: dict[str, tuple[str, ET.Element]] = {}
    seen = Counter()
    for e in root.iter():
        if tag(e) in GRAMMAR:
            attr, pattern = GRAMMAR[tag(e)]
            ident = e.get(attr)
            if not ident or not re.fullmatch(pattern, ident):
                bad("id-pattern", ident, f"{tag(e)} has a malformed id")
                continue
            seen[ident] += 1
            found[ident] = (tag(e), e)
    for ident, n in seen.items():
        if n > 1:
            bad("duplicate-id", ident, f"used {n} times")
    referred = set()
    for e in root.iter():
        t = tag(e)
        if t.endswith("Ref"):
            kind = t[: -len("IDRef")] if t.endswith("IDRef") and t != "audioTrackUIDRef" else "audioTrackUID"
            ident = (e.text or "").strip()
            referred.add(ident)
            if ident not in found:
                bad("unresolved", ident, f"{t} points to nothing")
            elif found[ident][0] != kind:
                bad("wrong-kind", ident, f"{t} points to a {found[ident][0]}")
    for ident, (t, e) in found.items():
        if t != "audioProgramme" and t != "audioBlockFormat" and ident not in referred:
            bad("unreferenced", ident, f"nothing refers to this {t}", "warning")
        if t in ("audioChannelFormat", "audioPackFormat") and e.get("typeLabel") == KIND and e.get("typeDefinition") != "DirectSpeakers":
            bad("type", ident, "label and definition differ")
        for a in ("start", "end", "rtime", "duration"):
            if e.get(a) is not None and not TIME.fullmatch(e.get(a)):
                bad("timecode", ident, f"{a} is {e.get(a)!r}")
        if t == "audioChannelFormat":
            _channel(ident, e, tag, bad)
        if t == "audioTrackUID":
            if rate and e.get("sampleRate") != str(rate):
                bad("rate", ident, f"{e.get('sampleRate')} against {rate} in the file")
            if bits and e.get("bitDepth") != str(bits):
                bad("depth", ident, f"{e.get('bitDepth')} against {bits} in the file")
    if uids is not None:
        own = {i for i, (t, _) in found.items() if t == "audioTrackUID"}
        for u in sorted(set(uids) ^ own):
            bad("chna", u, "in the track list or the XML alone")
    return out


def _channel(ident: str, e: ET.Element, tag, bad) -> None:
    blocks = [b for b in e if tag(b) == "audioBlockFormat"]
    if not blocks:
        bad("block", ident, "no block")
    for b in blocks:
        block = b.get("audioBlockFormatID") or ""
        if block[3:11].lower() != ident[3:11].lower():
            bad("block-id", block, f"not of {ident}")
        where = {p.get("coordinate"): p.text for p in b if tag(p) == "position"}
        label = next((x.text or "" for x in b if tag(x) == "speakerLabel"), "")
        if not label:
            bad("label", block, "no speaker label")
        if {"azimuth", "X"} <= set(where):
            bad("coordinates", block, "polar and Cartesian mixed")
        for axis, most in (("azimuth", 180.0), ("elevation", 90.0)):
            try:
                v = float(where.get(axis, "0"))
            except ValueError:
                bad("coordinates", block, f"{axis} isn't a number")
                continue
            if abs(v) > most:
                bad("range", block, f"{axis} {v}")
            m = re.fullmatch(r"([MUBT])([+-]\d{3})", label)
            if m and axis == "azimuth" and abs(v - float(m.group(2))) > 30:
                bad("label-azimuth", block, f"{label} at {v}")
            if m and axis == "elevation" and ((m.group(1) == "U" and v <= 0) or (m.group(1) == "B" and v >= 0)):
                bad("label-elevation", block, f"{label} at {v}")
        low = [f for f in b if tag(f) == "frequency"]
        if ("LFE" in label or "SUB" in label) and not low:
            bad("lfe", block, "a low-frequency channel without a limit", "warning")
        for f in low:
            if not 0 < float(f.text or 0) <= 500:
                bad("lfe", block, f"{f.text} Hz")


def elements(xmls: DataFrame) -> DataFrame:
    """doc_id, kind, ident, refers: a row for each identified element and each reference of XML texts (doc_id, xml).

    A text that can't be parsed is one row of kind ``error``.
    """

    def run(batches):
        for b in batches:
            rows = []
            for doc, xml in zip(b["doc_id"], b["xml"], strict=True):
                try:
                    root = ET.fromstring(xml)
                except ET.ParseError as e:
                    rows.append((doc, "error", str(e), False))
                    continue
                for e in root.iter():
                    tag = e.tag.rpartition("}")[2]
                    if tag in GRAMMAR:
                        rows.append((doc, tag, e.get(GRAMMAR[tag][0]) or "", False))
                    elif tag.endswith("Ref"):
                        kind = "audioTrackUID" if tag == "audioTrackUIDRef" else tag.removesuffix("IDRef")
                        rows.append((doc, kind, (e.text or "").strip(), True))
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "ident", "refers"])

    return xmls.select(F.col("doc_id").cast("long").alias("doc_id"), "xml").mapInPandas(run, "doc_id long, kind string, ident string, refers boolean")


def id_problems(xmls: DataFrame) -> DataFrame:
    """doc_id, rule, ident of everything wrong with the ids of many texts, by joins of their elements and references."""
    every = elements(xmls)
    c = F.col
    own = every.where("not refers and kind <> 'error'")
    patterns = F.create_map(*(F.lit(x) for kind, (_, p) in GRAMMAR.items() for x in (kind, f"^{p}$")))
    fit = F.regexp_like(c("ident"), F.element_at(patterns, c("kind")))
    broken = every.where("kind = 'error'").select("doc_id", F.lit("xml").alias("rule"), F.lit("").alias("ident"))
    malformed = own.where(~fit).select("doc_id", F.lit("id-pattern").alias("rule"), "ident")
    sound = own.where(fit)
    counted = sound.groupBy("doc_id", "ident").agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("own_kind"))
    twice = counted.where("n > 1").select("doc_id", F.lit("duplicate-id").alias("rule"), "ident")
    refs = every.where("refers")
    met = refs.join(counted, ["doc_id", "ident"], "left")
    lost = met.where("own_kind is null").select("doc_id", F.lit("unresolved").alias("rule"), "ident")
    other = met.where("own_kind <> kind").select("doc_id", F.lit("wrong-kind").alias("rule"), "ident")
    alone = counted.where("own_kind not in ('audioProgramme', 'audioBlockFormat')").join(refs, ["doc_id", "ident"], "left_anti").select("doc_id", F.lit("unreferenced").alias("rule"), "ident")
    return reduce(DataFrame.unionByName, (broken, malformed, twice, lost, other, alone))
