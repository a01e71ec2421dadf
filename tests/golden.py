"""Addresses and what the parser makes of them: number/suffix/last | flat | street | type | locality | state | postcode."""

GOLDEN = """
25 SAINT JAMES CT, TAMBORINE MOUNTAIN QLD 4272 => 25 | | SAINT JAMES | COURT | TAMBORINE MOUNTAIN | QLD | 4272
3/25 Saint James Ct, Tamborine Mountain QLD 4272 => 25 | UNIT 3 | SAINT JAMES | COURT | TAMBORINE MOUNTAIN | QLD | 4272
U3 25 Smith St, Sydney NSW 2000 => 25 | UNIT 3 | SMITH | STREET | SYDNEY | NSW | 2000
110-120 Musgrave Rd, Red Hill QLD 4059 => 110//120 | | MUSGRAVE | ROAD | RED HILL | QLD | 4059
190 MUSGRAVE RED HILL QLD 4059 => 190 | | MUSGRAVE | | RED HILL | QLD | 4059
Cambridge on the hill U20 110 musgrave rd red hill 4060 => 110 | UNIT 20 | MUSGRAVE | ROAD | RED HILL | | 4060
190a MUSGRAVE RD RED HILL QLD 4059 => 190/A | | MUSGRAVE | ROAD | RED HILL | QLD | 4059
U10 BLAH 6019 6 parkland bvd brisbane city QLD 4000 => 6 | UNIT 6019 | PARKLAND | BOULEVARD | BRISBANE CITY | QLD | 4000
6 UNIT 6019 parkland bvd brisbane city QLD 4000 => 6 | UNIT 6019 | PARKLAND | BOULEVARD | BRISBANE CITY | QLD | 4000
UNIT 6019 6 parkland bvdz, brisbane city QLD 4000 => 6 | UNIT 6019 | PARKLAND | BOULEVARD | BRISBANE CITY | QLD | 4000
25 St James Rode, Tamborine Mountain QLD 4272 => 25 | | SAINT JAMES | ROAD | TAMBORINE MOUNTAIN | QLD | 4272
1 Smith STX, Brisbane QLD 4000 => 1 | | SMITH | STREET | BRISBANE | QLD | 4000
F8 536 BEACONSFIELD TERRACE, BRIGHTON QLD 4017 => 536 | FLAT 8 | BEACONSFIELD | TERRACE | BRIGHTON | QLD | 4017
36 A1 TAVISTOCK ST, TORQUAY QLD 4655 => 36 | APARTMENT 1 | TAVISTOCK | STREET | TORQUAY | QLD | 4655
10 ST JAMES CT, ST LUCIA QLD 4067 => 10 | | SAINT JAMES | COURT | ST LUCIA | QLD | 4067
1 N SHORE DR, W END QLD 4101 => 1 | | NORTH SHORE | DRIVE | WEST END | QLD | 4101
5 12TH ST, SOUTH BRISBANE QLD 4101 => 5 | | TWELFTH | STREET | SOUTH BRISBANE | QLD | 4101
4000 SMITH STREEET BRISBANE QLD 4000 => 4000 | | SMITH | STREET | BRISBANE | QLD | 4000
Shop 14 Level 3 52 Davenport Rd, South Brisbane QLD 4101 => 52 | SHOP 14 | DAVENPORT | ROAD | SOUTH BRISBANE | QLD | 4101
Araby Lot 21 Armstrongs Lane, Moore QLD 4314 => | | ARMSTRONGS | LANE | MOORE | QLD | 4314
UNIT 3 221 The Avene, Peregian Spings Qld 4573 => 221 | UNIT 3 | THE AVENE | | PEREGIAN SPINGS | QLD | 4573
UNIT 5 10 Esplanade Broadbeach Qld 4218 => 10 | UNIT 5 | ESPLANADE | | BROADBEACH | QLD | 4218
10 Main Rd Sth, Sydney NSW 2000 => 10 | | MAIN | ROAD | SYDNEY | NSW | 2000
U 6019-6 Parkland Bvd, Brisbane Q 4001 => 6 | UNIT 6019 | PARKLAND | BOULEVARD | BRISBANE | QLD | 4001
Unit 6-6 Parkland Bvd Brisbane QLD 4001 => | UNIT 6-6 | PARKLAND | BOULEVARD | BRISBANE | QLD | 4001
40/B Smith Street, Brisbane QLD 4000 => 40/B | | SMITH | STREET | BRISBANE | QLD | 4000
Flinders View QLD 4305 => | | | | FLINDERS VIEW | QLD | 4305
4000 QLD 12 Smith Street => 12 | | SMITH | STREET | | QLD | 4000
Park View Apartments 3 12 Smith Street, Brisbane QLD 4000 => 12 | UNIT 3 | SMITH | STREET | BRISBANE | QLD | 4000
10 Park View Flinders View QLD 4305 => 10 | | PARK | VIEW | FLINDERS VIEW | QLD | 4305
19 EXCALIBUR CT PARADISE, POINT QLD 4216 => 19 | | EXCALIBUR | COURT | PARADISE POINT | QLD | 4216
10 Blue Hills Corner Malanda QLD 4885 => 10 | | BLUE HILLS | CORNER | MALANDA | QLD | 4885
3 / 40 / B Smith St, Brisbane QLD 4000 => 40/B | UNIT 3 | SMITH | STREET | BRISBANE | QLD | 4000
10 Smith St, 4012 QLD Nundah => 10 | | SMITH | STREET | NUNDAH | QLD | 4012
U&nbsp;20,&nbsp;25 Smith St, Kippa-Ring QLD 4021 => 25 | UNIT 20 | SMITH | STREET | KIPPA-RING | QLD | 4021
"""


def rows() -> list[tuple[str, str]]:
    return [tuple(line.split(" => ")) if " => " in line else (line.split(" =>")[0], "") for line in GOLDEN.strip().splitlines()]


def shown(r) -> str:
    """A parsed row in the notation above."""
    number = "" if r["in_number_first"] is None else str(r["in_number_first"])
    if r["in_number_suffix"] or r["in_number_last"]:
        number += f"/{r['in_number_suffix'] or ''}" + (f"/{r['in_number_last']}" if r["in_number_last"] else "")
    flat = " ".join(x for x in (r["in_flat_type"], r["in_flat_number"]) if x)
    parts = [number, flat, *(r[f"in_{c}"] or "" for c in ("street_name", "street_type", "locality", "state")), str(r["in_postcode"] or "")]
    return " | ".join(parts).strip()
