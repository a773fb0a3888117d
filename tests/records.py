"""Small tables of our own making: a tidy week of requests, and an untidy day or two."""

from __future__ import annotations

FIELDS = ("unique_key", "created_date", "due_date", "closed_date", "agency", "complaint_type", "borough")
SCHEMA = ", ".join(f"{f} string" for f in FIELDS)
SCHEMA_STATUS = SCHEMA + ", status string"


def may(day, time="00:00:00"):
    return None if day is None else f"2024-05-{day:02d}T{time}"


#: Seven requests; five closed after 2, 6, 0, 9 and 1 days, the second and fourth of them late.
WEEK = [
    ("a11", may(6, "08:15:00"), may(10, "17:00:00"), may(8, "11:00:00"), "PARKS", "Fallen Tree", "NORTH SHORE", "Done"),
    ("a12", may(6, "21:40:00"), may(9, "09:00:00"), may(12, "07:30:00"), "PARKS", "Fallen Tree", "NORTH SHORE", "Done"),
    ("a13", may(7, "10:05:00"), may(20, "12:00:00"), None, "WATER", "Leak", "HARBOUR", "Waiting"),
    ("a14", may(7, "10:05:00"), may(8, "10:05:00"), may(7, "23:59:00"), "WATER", "Leak", "HARBOUR", "Done"),
    ("a15", may(8), may(9), may(17, "06:00:00"), "ROADS", "Pothole", "OLD TOWN", "Done"),
    ("a16", may(8, "13:00:00"), may(15), None, "ROADS", "Pothole", "OLD TOWN", "Waiting"),
    ("a17", may(9, "07:00:00"), may(11, "07:00:00"), may(10, "19:00:00"), "ROADS", "Pothole", "HARBOUR", "Done"),
]

#: Five requests in all three default formats; one has a close time that is none.
UNTIDY = [
    ("u1", may(6, "08:15:00"), may(7), may(6, "20:00:00"), "PARKS", "Fallen Tree", "HARBOUR", "Done"),
    ("u2", "2024-05-06 23:10:00", "2024-05-08 12:00:00", "2024-05-09", "WATER", "Leak", "HARBOUR", "Done"),
    ("u3", "2024-05-07", "2024-05-09", None, "WATER", "Leak", "OLD TOWN", "Waiting"),
    ("u4", may(7, "12:30:00"), None, "soon", "ROADS", "Pothole", "OLD TOWN", "Waiting"),
    ("u5", "2024-05-08", "2024-05-10", "2024-05-10 00:00:00", "PARKS", "Graffiti", "NORTH SHORE", "Done"),
]
