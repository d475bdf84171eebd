"""WAV, AIFF and 64-bit RIFF containers: planning, writing, reading, rate sniffing and inspection."""

from __future__ import annotations

import math
import struct

import numpy as np

U32 = 0xFFFFFFFF
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
GUID_TAIL = bytes.fromhex("000000001000800000aa00389b71")


def padded(n: int) -> int:
    return n + n % 2


def plan_riff(chunks: list[tuple[str, int]], mode: str = "auto", most: int | None = 2**31 - 64) -> dict:
    """Container, sizes and offsets of chunks (id, size); 64-bit sizes where 32 bits can't hold them."""
    if mode not in ("auto", "riff", "rf64", "bw64"):
        raise ValueError(f"unknown mode {mode!r}")
    if not chunks or any(len(i) != 4 or s < 0 or i == "ds64" for i, s in chunks) or sum(i == "data" for i, _ in chunks) != 1:
        raise ValueError("chunks need four-letter ids, sizes and exactly one data chunk; ds64 is added here")
    body = 4 + sum(8 + padded(s) for _, s in chunks)
    wide = mode in ("rf64", "bw64") or body > U32
    if wide and mode == "riff":
        raise ValueError("a RIFF file can't hold this; it needs 64-bit sizes")
    size = body + 36 if wide else body
    if most is not None and size + 8 > most:
        raise ValueError(f"{(size + 8) / 2**30:.2f} GiB are over the limit of {most / 2**30:.2f} GiB")
    out, at = [], 12
    for i, s in ([("ds64", 28)] if wide else []) + list(chunks):
        out.append({"id": i, "size": s, "padded": padded(s), "size_field": U32 if wide and i == "data" else s, "offset": at})
        at += 8 + padded(s)
    return {"container": "RIFF" if not wide else "RF64" if mode == "rf64" else "BW64", "wide": wide, "size_field": U32 if wide else size, "riff_size": size, "total_bytes": size + 8, "data_size": dict(chunks)["data"], "chunks": out}


def describe_plan(plan: dict) -> str:
    return f"{plan['container']}, {plan['total_bytes']} bytes, {'64' if plan['wide'] else '32'}-bit sizes"


def _header(plan: dict, frames: int) -> bytes:
    out = plan["container"].encode() + struct.pack("<I", plan["size_field"]) + b"WAVE"
    if plan["wide"]:
        out += b"ds64" + struct.pack("<IQQQI", 28, plan["riff_size"], plan["data_size"], frames, 0)
    return out


def encode_pcm(x: np.ndarray, bits: int, big: bool = False) -> bytes:
    """Interleaved samples: integers of 16 or 24 bits, floats of 32."""
    flat = np.ascontiguousarray(x.T)
    if bits == 32:
        return flat.astype(">f4" if big else "<f4").tobytes()
    full = 2 ** (bits - 1)
    q = np.minimum(np.floor(np.clip(flat.astype(np.float64), -1, 1) * full + 0.5), full - 1).astype("<i4")
    if bits == 16:
        return q.astype(">i2" if big else "<i2").tobytes()
    three = q.reshape(-1, 1).view(np.uint8).reshape(-1, 4)[:, :3]
    return (three[:, ::-1] if big else three).tobytes()


def decode_pcm(raw: bytes, channels: int, bits: int, kind: int, big: bool = False) -> np.ndarray:
    """(channels, frames) floats; an incomplete last frame is left out."""
    step = channels * bits // 8
    raw = raw[: len(raw) // step * step]
    e = ">" if big else "<"
    if kind == FLOAT:
        x = np.frombuffer(raw, f"{e}f{bits // 8}").astype(np.float32)
    elif bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        b = b[:, ::-1] if big else b
        x = ((b[:, 0].astype(np.int32) | b[:, 1].astype(np.int32) << 8 | b[:, 2].astype(np.int8).astype(np.int32) << 16) / 2**23).astype(np.float32)
    elif bits == 8:
        x = (np.frombuffer(raw, np.int8 if big else np.uint8).astype(np.float32) - (0 if big else 128)) / 128
    else:
        x = (np.frombuffer(raw, f"{e}i{bits // 8}") / 2.0 ** (bits - 1)).astype(np.float32)
    return x.reshape(-1, channels).T


def write_wav(x: np.ndarray, rate: int, bits: int = 24, mask: int = 0, extensible: bool | None = None, mode: str = "auto", extra: list[tuple[str, bytes]] = ()) -> bytes:
    """A whole file; more than two channels or a mask make it extensible. ``extra`` chunks follow the data."""
    if bits not in (16, 24, 32) or not 1 <= len(x) <= 64 or rate <= 0:
        raise ValueError("16, 24 or 32 bits, 1 to 64 channels and a positive rate")
    wide = extensible if extensible is not None else len(x) > 2 or mask != 0
    tag, step = (FLOAT if bits == 32 else PCM), len(x) * bits // 8
    fmt = struct.pack("<HHIIHH", EXTENSIBLE if wide else tag, len(x), rate, rate * step, step, bits)
    if wide:
        fmt += struct.pack("<HHIH", 22, bits, mask, tag) + GUID_TAIL
    data = encode_pcm(x, bits)
    parts = [("fmt ", fmt), ("data", data), *extra]
    plan = plan_riff([(i, len(b)) for i, b in parts], mode)
    out = [_header(plan, x.shape[1])]
    sizes = {c["id"]: c["size_field"] for c in plan["chunks"]}
    for i, b in parts:
        out += [i.encode(), struct.pack("<I", sizes[i]), b, b"\0" * (len(b) % 2)]
    return b"".join(out)


def wav_head(channels: int, frames: int, rate: int, bits: int = 24, mask: int = 0, mode: str = "auto", extra: list[tuple[str, int]] = (), extensible: bool | None = None) -> bytes:
    """All that comes before the samples of a file whose length is known: the same bytes as ``write_wav``'s."""
    if bits not in (16, 24, 32) or not 1 <= channels <= 64 or rate <= 0:
        raise ValueError("16, 24 or 32 bits, 1 to 64 channels and a positive rate")
    wide, step = channels > 2 or mask != 0 if extensible is None else extensible, channels * bits // 8
    tag = FLOAT if bits == 32 else PCM
    fmt = struct.pack("<HHIIHH", EXTENSIBLE if wide else tag, channels, rate, rate * step, step, bits)
    if wide:
        fmt += struct.pack("<HHIH", 22, bits, mask, tag) + GUID_TAIL
    plan = plan_riff([("fmt ", len(fmt)), ("data", frames * step), *extra], mode, None)
    size = next(c["size_field"] for c in plan["chunks"] if c["id"] == "data")
    return _header(plan, frames) + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", size)


def stream_wav(sink, blocks, channels: int, frames: int, rate: int, bits: int = 24, mask: int = 0, extra: list[tuple[str, bytes]] = (), extensible: bool | None = None) -> int:
    """Write blocks of (channels, n) samples to a binary sink as they come; bytes written.

    Only one block is held. ``extra`` chunks follow the samples. Blocks that don't
    add up to ``frames``, or have another number of channels, are a ValueError.
    """
    head = wav_head(channels, frames, rate, bits, mask, "auto", [(i, len(b)) for i, b in extra], extensible)
    sink.write(head)
    done, size = 0, len(head)
    for block in blocks:
        if len(block) != channels:
            raise ValueError(f"a block of {len(block)} channels, not {channels}")
        raw = encode_pcm(block, bits)
        sink.write(raw)
        done, size = done + block.shape[1], size + len(raw)
    if done != frames:
        raise ValueError(f"{done} frames came, {frames} were announced")
    tail = b"\0" * (done * channels * bits // 8 % 2) + b"".join(i.encode() + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2) for i, b in extra)
    sink.write(tail)
    return size + len(tail)


def locate(f) -> dict:
    """Format, place and size of the samples in an open WAV file, read chunk head by chunk head."""
    head = f.read(12)
    if head[:4] not in (b"RIFF", b"RF64", b"BW64") or head[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    form, wide = None, None
    while len(raw := f.read(8)) == 8:
        ident, size = raw[:4], struct.unpack("<I", raw[4:])[0]
        if ident == b"ds64":
            body = f.read(padded(size))
            wide = struct.unpack("<QQQ", body[:24])
        elif ident == b"fmt ":
            body = f.read(padded(size))
            if size < 16:
                raise ValueError("fmt is cut off")
            tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            kind = struct.unpack("<H", body[24:26])[0] if tag == EXTENSIBLE and size >= 40 else tag
            form = {"channels": channels, "sample_rate": rate, "bits": bits, "kind": kind}
        elif ident == b"data":
            if not form or form["kind"] not in (PCM, FLOAT) or not form["channels"] or form["bits"] not in (8, 16, 24, 32, 64):
                raise ValueError("unsupported format")
            return form | {"offset": f.tell(), "size": wide[1] if size == U32 and wide else size}
        else:
            f.seek(padded(size), 1)
    raise ValueError("no data chunk")


def frame_blocks(f, first: int = 0, frames: int | None = None, block: int = 16384):
    """(start frame, samples, rate) of an open WAV file, from a frame on and as many as asked for; a block at a time."""
    at = locate(f)
    step = at["channels"] * at["bits"] // 8
    f.seek(at["offset"] + first * step)
    left = max(0, at["size"] // step - first)
    left = left if frames is None else min(left, frames)
    while left > 0:
        raw = f.read(min(block, left) * step)
        x = decode_pcm(raw, at["channels"], at["bits"], at["kind"])
        if not x.shape[1]:
            return
        yield first, x, at["sample_rate"]
        first, left = first + x.shape[1], left - x.shape[1]


def float80(v: float) -> bytes:
    """80-bit extended, big-endian."""
    if v == 0:
        return bytes(10)
    m, e = math.frexp(abs(v))
    return struct.pack(">HQ", (0x8000 if v < 0 else 0) | (e + 16382), int(m * 2**64))


def read_float80(b: bytes) -> float:
    e, m = struct.unpack(">HQ", b[:10])
    sign = -1.0 if e & 0x8000 else 1.0
    e &= 0x7FFF
    if e == 0x7FFF:
        return sign * (math.nan if m else math.inf)
    return 0.0 if not e and not m else sign * math.ldexp(m, e - 16383 - 63)


def write_aiff(x: np.ndarray, rate: int, bits: int = 24) -> bytes:
    if bits not in (16, 24):
        raise ValueError("16 or 24 bits")
    data = encode_pcm(x, bits, big=True)
    comm = struct.pack(">hIh", len(x), x.shape[1], bits) + float80(rate)
    ssnd = struct.pack(">II", 0, 0) + data
    body = b"AIFF" + b"".join(i + struct.pack(">I", len(b)) + b + b"\0" * (len(b) % 2) for i, b in ((b"COMM", comm), (b"SSND", ssnd)))
    return b"FORM" + struct.pack(">I", len(body)) + body


def inspect(raw: bytes) -> dict:
    """Chunks, format, errors and warnings of a RIFF, RF64 or BW64 file."""
    out: dict = {"container": None, "chunks": [], "errors": [], "warnings": [], "format": None}
    say = out["errors"].append
    if len(raw) < 12:
        say("shorter than a header")
        return out
    out["container"] = raw[:4].decode("latin-1")
    if out["container"] not in ("RIFF", "RF64", "BW64") or raw[8:12] != b"WAVE":
        say("not a RIFF/WAVE file")
        return out
    declared, wide = struct.unpack("<I", raw[4:8])[0], None
    at = 12
    while at + 8 <= len(raw):
        ident, size = raw[at : at + 4].decode("latin-1"), struct.unpack("<I", raw[at + 4 : at + 8])[0]
        if ident == "ds64" and at + 36 <= len(raw):
            wide = struct.unpack("<QQQ", raw[at + 8 : at + 32])
        real = wide[1] if ident == "data" and size == U32 and wide else size
        body = raw[at + 8 : at + 8 + real]
        out["chunks"].append({"id": ident, "offset": at, "size": real, "size_field": size, "padded": padded(real)})
        if len(body) < real:
            say(f"{ident.strip()} is cut off: {real} bytes declared, {len(body)} there")
        if ident == "fmt " and len(body) >= 16:
            tag, ch, rate, per_s, align, bits = struct.unpack("<HHIIHH", body[:16])
            f = {"tag": tag, "channels": ch, "sample_rate": rate, "bits": bits, "mask": None, "kind": tag}
            if tag == EXTENSIBLE and len(body) >= 40:
                f |= {"mask": struct.unpack("<I", body[20:24])[0], "kind": struct.unpack("<H", body[24:26])[0]}
                if bin(f["mask"]).count("1") not in (0, ch):
                    out["warnings"].append("mask bits and channels differ in number")
            if align != ch * bits // 8 or per_s != rate * align:
                out["warnings"].append("byte rate or block size doesn't fit the format")
            out["format"] = f
        if real % 2 and at + 8 + real < len(raw) and raw[at + 8 + real]:
            out["warnings"].append(f"{ident.strip()} has a pad byte that isn't zero")
        at += 8 + padded(real)
    ids = [c["id"] for c in out["chunks"]]
    for need in ("fmt ", "data"):
        if need not in ids:
            say(f"no {need.strip()} chunk")
    if "data" in ids and "fmt " in ids and ids.index("data") < ids.index("fmt "):
        out["warnings"].append("data before fmt")
    if out["container"] != "RIFF" and (wide is None or ids[0] != "ds64"):
        say("ds64 has to come first")
    if out["container"] == "RIFF" and declared + 8 != len(raw):
        out["warnings"].append(f"size field says {declared + 8} bytes, the file has {len(raw)}")
    return out


def read_wav(raw: bytes) -> tuple[np.ndarray, int]:
    found = inspect(raw)
    f = found["format"]
    data = next((c for c in found["chunks"] if c["id"] == "data"), None)
    if not f or not data or f["kind"] not in (PCM, FLOAT) or not f["channels"] or f["bits"] not in (8, 16, 24, 32, 64):
        raise ValueError("; ".join(found["errors"]) or "unsupported format")
    return decode_pcm(raw[data["offset"] + 8 : data["offset"] + 8 + data["size"]], f["channels"], f["bits"], f["kind"]), f["sample_rate"]


def read_aiff(raw: bytes) -> tuple[np.ndarray, int]:
    if raw[:4] != b"FORM" or raw[8:12] not in (b"AIFF", b"AIFC"):
        raise ValueError("not an AIFF file")
    at, comm, data = 12, None, None
    while at + 8 <= len(raw):
        ident, size = raw[at : at + 4], struct.unpack(">I", raw[at + 4 : at + 8])[0]
        body = raw[at + 8 : at + 8 + size]
        if ident == b"COMM" and len(body) >= 18:
            comm = struct.unpack(">hIh", body[:8]) + (read_float80(body[8:18]),)
        elif ident == b"SSND":
            data = body[8:]
        at += 8 + padded(size)
    if not comm or data is None:
        raise ValueError("no COMM or SSND chunk")
    return decode_pcm(data, comm[0], comm[2], PCM, big=True), int(math.floor(comm[3] + 0.5))


def sane(rate: float | None) -> bool:
    return rate is not None and math.isfinite(rate) and 8000 <= rate <= 192_000


def sniff_rate(b: bytes) -> int | None:
    """Sample rate by the bytes of a WAV (integer PCM or extensible), FLAC, AIFF or MPEG file."""
    for look in (_wav_rate, _flac_rate, _aiff_rate, _mpeg_rate):
        rate = look(b)
        if rate is not None:
            return rate
    return None


def _walk(b: bytes, at: int, order: str):
    while at + 8 <= len(b):
        size = struct.unpack(order + "I", b[at + 4 : at + 8])[0]
        yield b[at : at + 4], at
        at += 8 + padded(size)


def _wav_rate(b: bytes) -> int | None:
    if len(b) < 44 or b[:4] != b"RIFF" or b[8:12] != b"WAVE":
        return None
    for ident, at in _walk(b, 12, "<"):
        if ident == b"data":
            return None
        if ident == b"fmt " and at + 16 <= len(b):
            rate = struct.unpack("<I", b[at + 12 : at + 16])[0]
            return rate if struct.unpack("<H", b[at + 8 : at + 10])[0] in (PCM, EXTENSIBLE) and sane(rate) else None
    return None


def _flac_rate(b: bytes) -> int | None:
    if len(b) < 42 or b[:4] != b"fLaC" or b[4] & 0x7F or int.from_bytes(b[5:8], "big") < 34:
        return None
    rate = int.from_bytes(b[18:21], "big") >> 4
    return rate if sane(rate) else None


def _aiff_rate(b: bytes) -> int | None:
    if len(b) < 16 or b[:4] != b"FORM" or b[8:12] not in (b"AIFF", b"AIFC"):
        return None
    for ident, at in _walk(b, 12, ">"):
        if ident == b"SSND":
            return None
        if ident == b"COMM" and at + 26 <= len(b):
            rate = read_float80(b[at + 16 : at + 26])
            return int(math.floor(rate + 0.5)) if sane(rate) else None
    return None


# MPEG sample rates by version bits, and bit rates (kbit/s) by version 1 or not and layer bits.
MPEG_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
MPEG_KBPS = {
    (True, 3): "32 64 96 128 160 192 224 256 288 320 352 384 416 448",
    (True, 2): "32 48 56 64 80 96 112 128 160 192 224 256 320 384",
    (True, 1): "32 40 48 56 64 80 96 112 128 160 192 224 256 320",
    (False, 3): "32 48 56 64 80 96 112 128 144 160 176 192 224 256",
    (False, 2): "8 16 24 32 40 48 56 64 80 96 112 128 144 160",
    (False, 1): "8 16 24 32 40 48 56 64 80 96 112 128 144 160",
}


def _mpeg_frame(b: bytes, at: int) -> tuple[int, int | None] | None:
    """Rate and length of the frame at a place; the length is None where its bit rate is free or bad."""
    h = int.from_bytes(b[at : at + 4], "big")
    version, layer, index = h >> 19 & 3, h >> 17 & 3, h >> 10 & 3
    if h >> 21 != 0x7FF or version == 1 or layer == 0 or index == 3:
        return None
    rate, code = MPEG_RATES[version][index], h >> 12 & 15
    if code in (0, 15):
        return rate, None
    kbps = int(MPEG_KBPS[version == 3, layer].split()[code - 1])
    pad = h >> 9 & 1
    return rate, int((384 if layer == 3 else 1152) / 8 * kbps * 1000 / rate) + pad * (4 if layer == 3 else 1)


def _mpeg_rate(b: bytes) -> int | None:
    start = 0
    if len(b) >= 10 and b[:3] == b"ID3":
        start = 10 + sum((b[6 + i] & 0x7F) << (21 - 7 * i) for i in range(4))
    at = b.find(b"\xff", start)
    while 0 <= at < min(len(b) - 4, start + 65536):
        found = _mpeg_frame(b, at)
        if found:
            rate, length = found
            if length is None:
                return None
            after = _mpeg_frame(b, at + length) if at + length + 4 <= len(b) else None
            if after and after[0] == rate:
                return rate if sane(rate) else None
        at = b.find(b"\xff", at + 1)
    return None


# Speaker names of the WAVE mask, lowest bit first.
MASK_NAMES = "FL FR FC LFE BL BR FLC FRC BC SL SR TC TFL TFC TFR TBL TBC TBR".split()


def mask_names(mask: int) -> list[str]:
    return [n for i, n in enumerate(MASK_NAMES) if mask >> i & 1]
