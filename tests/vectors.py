"""Small metafiles with what is expected of them."""

import struct

H = bytes.fromhex


def element(class_id: int, element_id: int, *parts: bytes) -> bytes:
    """A short element: header, parameters, padding."""
    body = b"".join(parts)
    return struct.pack(">H", class_id << 12 | element_id << 5 | len(body)) + body + b"\0" * (len(body) % 2)


def said(text: str) -> bytes:
    return bytes([len(text)]) + text.encode()


def numbers(*values: int) -> bytes:
    return struct.pack(f">{len(values)}H", *values)


def singles(*values: float) -> bytes:
    return struct.pack(f">{len(values)}f", *values)


BINARY = {
    "short_padded": H("4123" "616263" "00"),
    "empty": b"",
    "semicolon": H("4127" "6162633b646566" "00"),
    "long_form": H("207f" "0005" "68656c6c6f" "00"),
    "two_parts": H("207f" "8003" "616263" "00" "0002" "6465"),
    "cell_array": H("413b" + "00" * 12 + "0002" "0003" "00000000" "5041594c4f4144" "00"),
    "rgb_cell": H("413a" + "00" * 12 + "0002" "0001" "0018" "0000" "ff0000" "00ff00"),
    "restricted": H("20c8" "0000" "0000" "0110" "018a" "43ae" "0078" "0014" "001e" "0028" "05" "48454c4c4f"),
    "poly_i16": H("1062" "0000" "1162" "0010" "4028" "0000" "0000" "0064" "0064"),
    "poly_i32": H("1062" "0000" "1162" "0020" "20d0" "4a127c00" "4a127c00" "4a24cb80" "4a24cb80" "4030" "002625a0" "002625a0" "0027ac40" "0027ac40"),
    "poly_f32": H("1062" "0001" "1182" "0020" "4030" "3f800000" "3f800000" "40000000" "40000000"),
    "clip": H("1062" "0001" "30a8" "0002" "0002" "0008" "0008" "30c1" "01" "00" "4030" "00000000" "00000000" "41200000" "41200000"),
    "color_table_16": H("5448" "00" "02" "ffff" "0000" "8000"),
    "color_extent": H("114c" "0000" "0000" "0000" "0fff" "0fff" "0fff"),
    # a scope with a name and a region: nine numbers, of which the last four are the box
    "hotspot_region": element(0, 21, said("PUMP-7"), numbers(0)) + element(9, 1, said("name"), said("INLET")) + element(9, 1, said("region"), bytes([18]), numbers(11, 1, 1, 16, 4, 90, 40, 130, 75)) + element(0, 22),
    # a scope without either: its box is that of a triangle and of a label, 8 wide and 3 high
    "hotspot_geometry": element(0, 21, said("SEAL_3"), b"\0") + element(4, 7, singles(4, 6, 9, 6, 9, 15)) + element(4, 29, numbers(8, 3, 7, 2), said("O-RING")) + element(0, 22),
}
TRUNCATED = H("4124" "7879")

TEXT = {
    "line": 'LINE 0 0 10 10; TEXT 5 6 "HELLO";',
    "bitonal_tile": "BEGTILEARRAY 0 0 0 0 1 1 2 2 0 0 0 0 2 2; BITONALTILE 2 16 0 1 '' 0123456789ABCDEFFEDCBA9876543210; ENDTILEARRAY;",
    "color_tile": "BEGTILEARRAY 0 0 0 0 1 1 2 2 0 0 0 0 2 2; COLORTILE 2 16 0 1 '' 00112233445566778899AABBCCDDEEFF; ENDTILEARRAY;",
    "index_tile": "BEGTILEARRAY 0 0 0 0 1 1 2 1 0 0 0 0 2 1; INDEXCOLORTILE 2 8 0 1 '' 0001; ENDTILEARRAY;",
    "direct_default": "BEGTILEARRAY 0 0 0 0 1 1 2 2 0 0 0 0 2 2; DIRECTCOLORTILE '' 00112233445566778899AABBCCDDEEFF; ENDTILEARRAY;",
    "primitives": "DISJOINTPOLYLINE 0 0 1 1; POLYMARKER 1 1; POLYGONSET 0 0 1 0 1 1; RECTANGLE 0 0 2 2; CIRCLE 0 0 1; ARC3PT 0 0 5 10 10 0; ARCCENTRE 0 0 1 0 0 1; ELLIPSE 0 0 1 0 0 1; ELLIPARC 0 0 1 0 0 1 1 0 0 1; GDP 1 2 3;",
    "transparency": "TRANSPARENCY OFF; TRANSPARENCYMODE ON; TRANSPMODE 0;",
    "clipping": "CLIPRECT 1 2 11 22; CLIPIND ON; CLIPIND OFF;",
    "cell_text": "CELLARRAY 0 0 1 0 0 1 2 2 8 1 2 3 4;",
    "tile_meta": "BEGTILEARRAY 0 0 0 0 1 1 3 4 0 0 0 0 3 4; COLORTILE 2 24 0 1 1 '' " + "FF0000" * 12 + "; ENDTILEARRAY;",
    "hotspot_text": 'BEGAPS "FLANGE"; APD "name" "GASKET"; APD "region" "3 8 21 33"; ENDAPS;',
    "stray_quote": 'VDCEXT 0 0 60 40; LINE 5 5 20 9; BEGAPS "HINGE"; "APD "name" "LEFT"; APD "region" "2 2 7 9"; ENDAPS;',
    "two_color_tiles": "BEGTILEARRAY 0 0 0 0 2 1 4 2 0 0 0 0 8 2; COLORTILE 2 8 0 1 '' " + "FF0000FF" * 8 + "; COLORTILE 2 8 0 1 '' " + "00FF00FF" * 8 + "; ENDTILEARRAY;",
    "scaled": "COLRVALUEEXT 1024 1024 1024 3072 3072 3072; BEGTILEARRAY 0 0 0 0 1 1 2 1 0 0 0 0 2 1; DIRECTCOLORTILE 2 16 0 1 '' 000004000c000c000800ffff; ENDTILEARRAY;",
}
