"""Invented source tables of the study, with every edge the pipelines must handle."""

from __future__ import annotations

import datetime as dt
import random

CATEGORIES = ["Cardiovascular", "Respiratory", "Musculoskeletal", "Diabetes", "Cancer", "AoD", "Dementia", None]
ITEMS = ["23", "36", "5028/1", "5043/1/99", "12A", "0", None, "99902", "10997", "721", "91790", "729", "900", "10955"]
REFERRALS = ["Cardiology", "Thoracic", "Geriatrics", "Hospital / Emergency Department", "Other", None]
CODES = ["A01", "C09", "T10", "N02", None, "", "X99"]


def _stamp(day: dt.date) -> str:
    return f"{day.isoformat()} 09:30:00"


def tables(spark, persons: int = 160, seed: int = 7) -> dict:
    rnd = random.Random(seed)
    start = dt.date(2022, 1, 1)

    def some_day(lo: int = 0, hi: int = 1360) -> dt.date:
        return start + dt.timedelta(days=rnd.randint(lo, hi))

    patient, flags, diag, service, referral, script = [], [], [], [], [], []
    roster_a, roster_a_cond, roster_b, roster_b_cond = [], [], [], []
    for i in range(persons):
        person, site = f"P{i:04d}", rnd.choice([11, 12, 13, 14])
        yob, mob, sex = rnd.randint(1930, 1958), rnd.randint(1, 12), rnd.choice(["Male", "Female"])
        post = 3000 + rnd.randint(0, 40)
        if i == 3:
            sex = "Other"
        dead = i % 29 == 5
        keys = [f"{site}-{i}"]
        patient.append((keys[0], person, str(yob), str(mob), sex, "Unknown" if i == 8 else str(post), str(site),
                        "2024" if dead else "NULL", "5" if dead else "NULL"))
        if i % 17 == 0:  # a person at two sites
            keys.append(f"15-{i}")
            patient.append((keys[1], person, str(yob), str(mob), sex, str(post), "15", "NULL", "NULL"))
        role = i % 4
        enrolled = some_day(200, 1000)
        if role == 0:
            flags.append((keys[0], "Program Enrolled", _stamp(enrolled)))
            if i % 8 == 0:
                flags.append((keys[0], "Program Enrolled", _stamp(enrolled + dt.timedelta(days=200))))
                flags.append((keys[0], "Program Graduated", _stamp(enrolled + dt.timedelta(days=120))))
            dob = f"15{dt.date(2000, mob, 1).strftime('%b').lower()}{yob} 00:00:00"
            grad = enrolled + dt.timedelta(days=100) if i % 3 else None
            withdrawn = enrolled + dt.timedelta(days=2 if i % 24 == 4 else 300) if i % 5 == 4 else None
            roster_a.append((f"A{i}", "11B" if site == 11 else str(site), dob, sex, str(post), enrolled, enrolled, grad, withdrawn,
                             ("Died" if i % 10 == 4 else "Moved") if withdrawn else None))
            if i % 8 == 0:
                roster_a.append(roster_a[-1][:6] + (enrolled + dt.timedelta(days=210),) + roster_a[-1][7:])
            if i % 12:
                roster_a_cond.append((f"A{i}", rnd.choice(["Chronic Complex- Angina", "Chronic Complex- Asthma", "Other"])))
        elif role == 1:
            flags.append((keys[0], rnd.choice(["Program Graduated", "Program  Referred", "Program Withdrawn"]), _stamp(enrolled)))
            roster_b.append((f"B{i}", f"{site}-B{i}", dt.date(yob, mob, 20), sex, str(post), enrolled, enrolled,
                             (enrolled + dt.timedelta(days=400)).strftime("%d/%m/%Y") if i % 9 == 0 else None,
                             enrolled + dt.timedelta(days=150) if i % 2 else None))
            roster_b_cond.append((f"B{i}", rnd.choice(["Cardiovascular Disease", "Frailty/Falls Risk"])))
        else:
            flags.append((keys[0], "Program Eligible", _stamp(some_day())))
        flags.append((keys[0], "Other", "not a date"))
        for key in keys:
            for _ in range(rnd.randint(1, 4)):
                diag.append((key, _stamp(some_day(-300)), rnd.choice(CATEGORIES)))
            diag.append((key, _stamp(some_day()), "Cardiovascular"))
            for _ in range(rnd.randint(5, 40)):
                service.append((key, _stamp(some_day()), rnd.choice(ITEMS), rnd.choice(["d1", "d2", None]), str(site)))
            for _ in range(rnd.randint(0, 8)):
                referral.append((key, _stamp(some_day()), rnd.choice(REFERRALS)))
                script.append((key, _stamp(some_day()), rnd.choice(CODES)))
    roster_a_cond.append(("nobody", "Chronic Complex- Asthma"))
    roster_b_cond.append((None, None))
    half = len(service) // 2
    date, text = "date", "string"

    def frame(data, *fields):
        schema = ", ".join(f if " " in f else f"{f} string" for f in fields)
        return spark.createDataFrame(data, schema)

    return {
        "patient": frame(patient, "patientsitekey", "person_id", "yob", "mob", "sex", "post_code", "practice_id", "yod", "mod"),
        "patientflag": frame(flags, "patientsitekey", "flag_status", "flag_datetime"),
        "diagnosis": frame(diag, "patientsitekey", "diagnosis_recorded_date", "chronic_disease_category"),
        "service_older": frame(service[:half], "patientsitekey", "service_date", "service_item", "providersitekey", "practice_id"),
        "service": frame(service[half:], "patientsitekey", "service_date", "service_item", "providersitekey", "practice_id"),
        "referral": frame(referral, "patientsitekey", "referral_date", "referral_category"),
        "prescription": frame(script, "patientsitekey", "prescription_date", "atc_code"),
        "roster_a": frame(roster_a, "key", "practice_id", "dob", "sex", "post_code", "referral date", "enrolled date",
                          "graduated date", "withdrawn date", "withdrawal_reason"),
        "roster_a_conditions": frame(roster_a_cond, "key", "diagnosis"),
        "roster_b": frame(roster_b, "id", "key", "dob date", "sex", "post_code", "referral date", "enrolled date", "withdrawn",
                          "graduated date"),
        "roster_b_conditions": frame(roster_b_cond, "id", "diagnosis_group"),
        "area_index": frame([(p, 1000, p % 10) for p in range(3000, 3041)], "post_code int", "population int", "area_index int"),
        "decisions": frame([(f"P{i:04d}", int(i % 3 != 0)) for i in range(1, persons, 4)], "person_id string", "keep int"),
        "excluded_sites": frame([("14",)], "site string"),
    }
