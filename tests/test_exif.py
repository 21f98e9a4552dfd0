import struct

import numpy as np
from pyspark.sql import functions as F

from evidoc.sources import exif, uploads


def segment(orientation, order="<", tag=0x0112, kind=3, before=2, gap=0):
    """A metadata segment with one orientation entry behind ``before`` others."""
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8 + gap) + bytes(gap)
    entries = [struct.pack(order + "HHIHH", 0x0100 + k, 3, 1, 6, 0) for k in range(before)] + [struct.pack(order + "HHIHH", tag, kind, 1, orientation, 0)]
    body = b"Exif\0\0" + head + struct.pack(order + "H", len(entries)) + b"".join(entries) + bytes(4)
    return b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body


def oriented(spark, files):
    rows = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in files.items()], "k string, content binary")
    return {r["k"]: (r["o"], r["q"]) for r in rows.select("k", exif.orientation(F.col("content")).alias("o"), exif.quarters(F.col("content")).alias("q")).collect()}


def test_orientations_of_both_byte_orders_and_damaged_files(spark):
    start, rest = b"\xff\xd8", b"\xff\xda\x00\x04\x00\x00pixels"
    other = b"\xff\xe0\x00\x10JFIF" + bytes(10)
    files = {f"{o}{code}": start + other * (code % 3) + segment(code, o, gap=code) + rest for o in "<>" for code in range(10)}
    want = {f"{o}{code}": (code if 1 <= code <= 8 else None, {3: 2, 6: 1, 8: 3}.get(code, 0)) for o in "<>" for code in range(10)}
    whole = start + other + segment(6) + rest
    files |= {f"cut {n}": whole[:n] for n in range(0, len(whole), 5)}
    want |= {f"cut {n}": (6, 1) if n >= whole.index(b"\x12\x01") + 10 else (None, 0) for n in range(0, len(whole), 5)}
    odd = {
        "none": start + other + rest, "null": None, "png": b"\x89PNG\r\n\x1a\n" + segment(6), "after pixels": start + rest + segment(6), "other tag": start + segment(6, tag=0x0113) + rest,
        "other type": start + segment(6, kind=4) + rest, "no magic": start + segment(6).replace(b"*\0", b"+\0") + rest, "far offset": start + segment(6).replace(struct.pack("<I", 8), b"\xff" * 4, 1) + rest,
        "short length": start + b"\xff\xe0\x00\x01" + segment(6), "not exif": start + segment(6).replace(b"Exif", b"exif") + rest, "many segments": start + other * 40 + segment(6) + rest,
    }
    assert oriented(spark, files | odd) == want | dict.fromkeys(odd, (None, 0))


def test_photographs_are_read_upright(spark, tmp_path):
    """JPEG files written by the Java platform, with metadata put in; a PNG has none."""
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(32, 16, 1)
    for x in range(32):
        for y in range(16):
            image.setRGB(x, y, 0xFFFFFF if x < 16 and y < 8 else 0)  # the upper left quarter is white
    for kind in ("jpg", "png"):
        jvm.javax.imageio.ImageIO.write(image, kind, jvm.java.io.File(str(tmp_path / f"plain.{kind}")))
    plain = (tmp_path / "plain.jpg").read_bytes()
    for code in (1, 3, 6, 8):
        (tmp_path / f"turned+ {code}.jpg").write_bytes(plain[:2] + segment(code, ">" if code == 6 else "<") + plain[2:])
    (tmp_path / "damaged.jpg").write_bytes(plain[:2] + segment(6)[:10] + bytes(len(segment(6)) - 10) + plain[2:])
    got = {}
    for r in uploads.read_images(spark, str(tmp_path)).collect():
        i = r["image"]
        pixels = np.frombuffer(i["data"], dtype=np.uint8).reshape(i["height"], i["width"], i["nChannels"])[:, :, 0] > 128
        h, w = pixels.shape
        quarter = [bool(pixels[: h // 2, : w // 2].mean() > 0.5), bool(pixels[: h // 2, w // 2 :].mean() > 0.5), bool(pixels[h // 2 :, w // 2 :].mean() > 0.5), bool(pixels[h // 2 :, : w // 2].mean() > 0.5)]
        assert sum(quarter) == 1
        got[i["origin"].rsplit("/", 1)[1].replace("%20", " ")] = ((w, h), quarter.index(True))  # clockwise from the upper left
    flat, tall = (32, 16), (16, 32)
    assert got == {"plain.jpg": (flat, 0), "plain.png": (flat, 0), "damaged.jpg": (flat, 0), "turned+ 1.jpg": (flat, 0), "turned+ 3.jpg": (flat, 2), "turned+ 6.jpg": (tall, 1), "turned+ 8.jpg": (tall, 3)}
