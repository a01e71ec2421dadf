"""Dictionaries of the address vocabulary.

The street-type table is a parameter: ``StreetTypes.read`` takes a two-column CSV (name, abbreviation) of a national
standard; without one, the common types below serve. All look-ups are Spark map literals or plain dicts.
"""

from __future__ import annotations

import csv
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Common street types of Australian addresses with their abbreviations, as the address standard has them.
COMMON_STREET_TYPES = """
ALLEY ALLY|AL|ALY; APPROACH APP; ARCADE ARC; AVENUE AV|AVE; BEND BEND; BOULEVARD BVD|BLVD|BVDE; BRACE BR; BROADWAY BDWY; BYPASS BYPA;
CAUSEWAY CSWY; CENTRE CTR|CTRE; CHASE CH; CIRCLE CIR; CIRCUIT CCT|CRCT; CLOSE CL; CONCOURSE CON|CONC; CORNER CNR|COR; COURT CT|CRT; COVE COVE;
CRESCENT CR|CRES; CREST CRST; CROSS CRSS; CROSSING CRSG; CUL-DE-SAC CDS; DALE DALE; DRIVE DR|DRV; DRIVEWAY DVWY; EDGE EDGE; END END;
ENTRANCE ENT; ESPLANADE ESP|ESPL; ESTATE EST; EXPRESSWAY EXP|EXWY; FAIRWAY FAWY; FREEWAY FWY; FRONT FRNT; GARDENS GDNS; GATE GTE; GLADE GLD;
GLEN GLEN; GRANGE GRA; GREEN GRN; GROVE GR|GRV; HEIGHTS HTS; HIGHWAY HWY; HILL HILL; JUNCTION JNC; LANDING LDG; LANE LANE|LN; LINK LINK;
LOOKOUT LKT; LOOP LOOP; MALL MALL; MEWS MEWS; MILE MILE; MOTORWAY MWY; NOOK NOOK; OUTLOOK OTLK; PARADE PDE; PARK PARK; PARKWAY PWY|PKWY;
PASS PASS; PASSAGE PSGE; PATH PATH; PLACE PL; PLAZA PLZA; POCKET PKT; POINT PNT; PROMENADE PROM; QUAY QY; QUAYS QYS; RAMP RAMP; RANGE RNGE;
REACH RCH; RESERVE RES; REST REST; RETREAT RTT; RIDGE RDGE; RING RING; RISE RISE; RIVER RVR; ROAD RD; ROUTE RTE; ROW ROW; SQUARE SQ; STREET ST|STR;
STRAND STRA; STRIP STRP; SUBWAY SBWY; TERRACE TCE|TER; TRACK TRK|TRAK; TRAIL TRL; TURN TURN; VALE VALE; VALLEY VLLY; VIEW VIEW|VW; VISTA VSTA;
WALK WALK|WK; WALKWAY WKWY; WATERS WTRS; WAY WAY|WY; WHARF WHRF; WYND WYND; YARD YARD
"""
# Words that are both street types (or directions) and parts of names.
COLLISION_WORDS = frozenset(
    "ST NORTH NTH SOUTH STH EAST WEST HILL HILLS HEIGHTS BAY BEACH ISLAND PARK POINT PORT VALLEY VIEW MILE RING END RIVER GLEN GROVE RISE VALE DALE WATERS WOOD "
    "PARADISE LOOKOUT DOWNS RANGE BRANCH ESTATE RIDGE COVE HARBOUR GAP RESERVE GARDENS POCKET LANDING GRANGE NEST FLAT JUNCTION".split()
)
# Unit and level designators, directions, states.
FLAT_TYPES = {
    "UNIT": "UNIT U", "FLAT": "FLAT F FLT", "APARTMENT": "APARTMENT APT A", "SUITE": "SUITE STE SE", "SHOP": "SHOP SHP", "OFFICE": "OFFICE OFF OFFC", "VILLA": "VILLA VLLA", "TOWNHOUSE": "TOWNHOUSE TNHS", "STUDIO": "STUDIO STU",
    "FACTORY": "FACTORY FCTY FY", "WAREHOUSE": "WAREHOUSE WHSE WE", "KIOSK": "KIOSK KSK", "ROOM": "ROOM RM", "SHED": "SHED", "SITE": "SITE", "STALL": "STALL STLL", "DUPLEX": "DUPLEX DUP", "COTTAGE": "COTTAGE CTGE",
    "PENTHOUSE": "PENTHOUSE PTHS", "LOFT": "LOFT", "BLOCK": "BLOCK BLCK", "HALL": "HALL", "CABIN": "CABIN", "HOUSE": "HOUSE HSE",
}
LEVEL_TYPES = {"LEVEL": "LEVEL L LVL LEV FLOOR FL", "GROUND": "GROUND G", "BASEMENT": "BASEMENT B BSMT", "MEZZANINE": "MEZZANINE M", "PARKING": "PARKING P"}
DIRECTIONS = {"NORTH": "N NTH NORTH", "SOUTH": "S STH SOUTH", "EAST": "E EAST", "WEST": "W WEST", "NORTH EAST": "NE", "NORTH WEST": "NW", "SOUTH EAST": "SE", "SOUTH WEST": "SW"}
STATES = {
    "QLD": "QLD QUEENSLAND", "NSW": "NSW NEW_SOUTH_WALES", "VIC": "VIC VICTORIA", "SA": "SA SOUTH_AUSTRALIA", "WA": "WA WESTERN_AUSTRALIA", "TAS": "TAS TASMANIA", "NT": "NT NORTHERN_TERRITORY",
    "ACT": "ACT AUSTRALIAN_CAPITAL_TERRITORY",
}
STATE_LETTERS = {"Q": "QLD", "V": "VIC", "S": "SA", "W": "WA", "T": "TAS", "A": "ACT"}
ATTACHED_FLAT = {"U": "UNIT", "F": "FLAT", "A": "APARTMENT"}


def inverted(groups: dict[str, str]) -> dict[str, str]:
    """alias -> canonical name; underscores stand for spaces."""
    return {alias.replace("_", " "): name for name, aliases in groups.items() for alias in aliases.split()}


class StreetTypes:
    """name or abbreviation -> canonical street type."""

    def __init__(self, canonical: dict[str, str]) -> None:
        self.canonical = canonical
        self.longest_first = sorted(canonical, key=lambda w: (-len(w), w))

    @classmethod
    def common(cls) -> "StreetTypes":
        return _common_street_types()

    @classmethod
    def read(cls, path: str) -> "StreetTypes":
        """A CSV with the columns name and abbreviation (or two columns in this order)."""
        with open(path, newline="", encoding="utf-8-sig") as f:
            rows = [[x.strip().upper() for x in row[:2]] for row in csv.reader(f) if len(row) >= 2]
        if rows and not set(rows[0]).isdisjoint(("NAME", "ABBREVIATION", "CODE")):
            rows = rows[1:]
        return cls({a: name for name, a in rows if a} | {name: name for name, _ in rows})


@cache
def _common_street_types() -> StreetTypes:
    found: dict[str, str] = {}
    for entry in COMMON_STREET_TYPES.replace("\n", " ").split(";"):
        name, short = entry.split()
        found[name] = name
        found.update(dict.fromkeys(short.split("|"), name))
    return StreetTypes(found)


def score_flat_types() -> dict[str, str]:
    """Flat types as the scorer sees them: UNIT, FLAT and APARTMENT are one."""
    return {k: "UNIT" if v in ("APARTMENT", "FLAT") else v for k, v in inverted(FLAT_TYPES).items()}


def mapped(column: Column, table: dict[str, str]) -> Column:
    """The canonical value of a column, or the value itself."""
    literal = F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair])
    return F.coalesce(F.try_element_at(literal, column), column)
