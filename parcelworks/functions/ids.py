"""Location-based parcel ids: geohash, check character, minting and validation, all as bit arithmetic on Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelworks.functions.text import let

# The geohash alphabet, and two-letter state codes.
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
STATE_CODES = {
    "ANDHRA PRADESH": "AP", "ASSAM": "AS", "BIHAR": "BR", "CHHATTISGARH": "CG", "GOA": "GA", "GUJARAT": "GJ", "HARYANA": "HR", "HIMACHAL PRADESH": "HP",
    "JHARKHAND": "JH", "KARNATAKA": "KA", "KERALA": "KL", "MADHYA PRADESH": "MP", "MAHARASHTRA": "MH", "MANIPUR": "MN", "MEGHALAYA": "ML", "MIZORAM": "MZ",
    "NAGALAND": "NL", "ODISHA": "OD", "PUNJAB": "PB", "RAJASTHAN": "RJ", "SIKKIM": "SK", "TAMIL NADU": "TN", "TELANGANA": "TS", "TRIPURA": "TR",
    "UTTAR PRADESH": "UP", "UTTARAKHAND": "UK", "WEST BENGAL": "WB", "DELHI": "DL", "JAMMU AND KASHMIR": "JK", "LADAKH": "LA", "PUDUCHERRY": "PY",
}
LENGTH, PRECISION = 14, 11
#: The alphabet by bits 1, 3 and 5 of a character's five, then 2 and 4.
WOVEN = "".join(ALPHABET[(a >> 2 & 1) << 4 | (b >> 1 & 1) << 3 | (a >> 1 & 1) << 2 | (b & 1) << 1 | a & 1] for a in range(8) for b in range(4))


def _cell(x: Column, low: float, width: float, bits: int) -> Column:
    """Number of the cell that ``x`` lies in when the range is halved ``bits`` times; a midpoint belongs to the lower half."""
    return F.greatest(F.ceil((x - low) / width * float(1 << bits)) - 1, F.lit(0)).cast("long")


def geohash(lat: Column, lon: Column, n: int = PRECISION) -> Column:
    """Geohash of ``n`` characters; null for a position out of range."""
    lon_bits, lat_bits = (5 * n + 1) // 2, 5 * n // 2

    def chars(cell: Column) -> Column:
        def char(i: int) -> Column:
            """Five bits in turn from both cells, the first from ``x`` where i is even: three of one and two of the other tell the
            character, by an alphabet in their order."""
            a, b = (cell["x"], cell["y"]) if i % 2 == 0 else (cell["y"], cell["x"])
            bits_a, bits_b = (lon_bits, lat_bits) if i % 2 == 0 else (lat_bits, lon_bits)
            first_a, first_b = (5 * i + 1) // 2, (5 * i + 1) // 2
            if i % 2:
                first_a, first_b = 5 * i // 2, 5 * i // 2 + 1
            part = lambda of, bits, first, k: F.shiftright(of, bits - first - k).bitwiseAND(F.lit((1 << k) - 1))
            place = part(a, bits_a, first_a, 3) * 4 + part(b, bits_b, first_b, 2)
            return F.substr(F.lit(WOVEN), (place + 1).cast("int"), F.lit(1))

        return F.concat(*[char(i) for i in range(n)])

    inside = lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
    cells = F.struct(_cell(lon, -180.0, 360.0, lon_bits).alias("x"), _cell(lat, -90.0, 180.0, lat_bits).alias("y"))
    return F.when(inside, let(cells, chars))


def geohash_centre(code: Column, n: int = PRECISION) -> tuple[Column, Column]:
    """Latitude and longitude of the centre of a cell; nulls if a character is not in the alphabet or the length is not n."""
    lon_bits, lat_bits = (5 * n + 1) // 2, 5 * n // 2

    def centre_of(c: Column) -> Column:
        places = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (F.position(F.substr(c, i, F.lit(1)), F.lit(ALPHABET)) - 1).cast("long"))
        return let(places, lambda v: F.struct(gather(v, 1, lat_bits).alias("lat"), gather(v, 0, lon_bits).alias("lon")))

    def gather(v: Column, first: int, bits: int) -> Column:
        places = [2 * k + first for k in range(bits)]
        return sum((F.shiftright(v[b // 5], 4 - b % 5).bitwiseAND(F.lit(1)) * (1 << (bits - 1 - k)) for k, b in enumerate(places)), F.lit(0).cast("long"))

    found = let(code, lambda c: F.when(sound_of(c, n), centre_of(c)))
    return (found["lat"] + 0.5) * (180.0 / (1 << lat_bits)) - 90.0, (found["lon"] + 0.5) * (360.0 / (1 << lon_bits)) - 180.0


def sound_of(code: Column, n: int) -> Column:
    return (F.length(code) == n) & code.rlike(f"^[{ALPHABET}]*$")


def check_character(payload: Column, n: int = LENGTH - 1) -> Column:
    """Check character of the first ``n`` characters: their values, weighted by position from 2 on, modulo 32."""

    def term(low: Column, i: Column) -> Column:
        c = F.substr(low, i, F.lit(1))
        return let(F.position(c, F.lit(ALPHABET)), lambda place: F.when(place > 0, place - 1).otherwise(F.pmod(F.ascii(c) - 55, F.lit(32)))) * (i + 1)

    total = let(F.lower(payload), lambda low: F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda acc, i: acc + term(low, i)))
    return F.substr(F.lit(ALPHABET), (total % 32 + 1).cast("int"), F.lit(1))


def state_code(state: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for kv in STATE_CODES.items() for x in kv])
    return F.coalesce(F.element_at(codes, F.upper(F.trim(F.coalesce(state, F.lit(""))))), F.lit("IN"))


def mint(lat: Column, lon: Column, state: Column) -> Column:
    """State code, geohash and check character in capitals; null without a valid position."""
    payload = F.concat(state_code(state), geohash(lat, lon))
    return let(payload, lambda p: F.upper(F.concat(p, check_character(p))))


def is_valid(ulpin: Column) -> Column:
    """Length, characters and check character; false for null and empty."""

    def sound(u: Column) -> Column:
        body = F.substr(u, F.lit(1), F.lit(LENGTH - 1))
        return (F.length(u) == LENGTH) & body.rlike(r"^(?:[0-9]|\p{L})*$") & (F.lower(F.substr(u, F.lit(LENGTH), F.lit(1))) == check_character(body))

    return F.coalesce(let(ulpin, sound), F.lit(False))


def centre(ulpin: Column) -> tuple[Column, Column, Column]:
    """Latitude, longitude and error of an id: the error tells that it is not valid or names no cell."""
    lat, lon = geohash_centre(F.lower(F.substr(ulpin, F.lit(3), F.lit(PRECISION))))
    valid = is_valid(ulpin)
    return F.when(valid, lat), F.when(valid, lon), F.when(~valid, "check character").when(lat.isNull(), "geohash")


def identity_digest(number: Column, salt: str) -> Column:
    """Salted SHA-256 of the 12 digits of an identity number; null unless there are just 12."""
    digits = F.regexp_replace(number, "[^0-9]", "")
    return F.when(F.length(digits) == 12, F.sha2(F.concat(F.lit(salt + ":"), digits).cast("binary"), 256))


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)
