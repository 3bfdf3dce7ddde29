"""Fixed values of the study design: code sets, category names, letters, outcomes."""

# Service item codes by kind of service. A tuple is a closed range. Sets
# overlap on purpose, so a code can count in several.
SERVICE_CODE_SETS = {
    "service_tele_pooled": [91790, 91800, 91801, 91802, 91920, 91890, 91891, 91900, 91910],
    "service_gp_pooled": [
        3, 23, 36, 44, 123, 4, 24, 37, 47, 124, 5000, 5020, 5040, 5060, 5071, 5003, 5023, 5043,
        5063, 5076, 5010, 5028, 5049, 5067, 5077, 90020, 90035, 90043, 90051, 90054],
    "service_cdm_gpmp": [721, 92024, 965, 92029],
    "service_cdm_tca": [723, 92025],
    "service_cdm_review": [732, 92028, 967, 92030],
    "service_cdm_mdmp": [729, 92026, 731, 92027],
    "service_prac_nurse_complete": [10997, 10983, 10987],
    "service_prac_nurse_chronic": [10997, 93201, 93203],
    "service_alliedhealth": [(10950, 10970)],
    "service_gp_ha": [701, 703, 705, 707, 715],
    "service_heart_health": [699],
    "service_mhp": [2700, 2701, 2712, 2713, 2715, 2717, 92112, 92113, 92116, 92117, 92114, 921126,
                    92115, 92127],
    "service_caseconf": [735, 739, 743, 747, 750, 758],
    "service_medreview": [900],
}
SERVICE_CODE_RANGE = (1, 99901)

# Referral categories by group.
REFERRAL_SETS = {
    "referral_number_HA_ED": ["Hospital / Emergency Department"],
    "referral_cardio": ["Cardiology", "Vascular Surgery", "Neurology"],
    "referral_respiratory": ["Respiratory & Sleep Medicine", "Respiratory physician", "Thoracic"],
    "referral_frailty": ["Geriatrics"],
}

# First letters of the prescription class; the total leaves out T.
CLASS_LETTERS = ["A", "B", "C", "D", "G", "H", "J", "L", "M", "N", "P", "R", "S", "T", "V"]
TOTAL_LETTERS = [c for c in CLASS_LETTERS if c != "T"]

# Diagnosis categories of the extract.
EXTRACT_CONDITIONS = {
    "cardio": ["Cardiovascular"],
    "respiratory": ["Respiratory"],
    "cancer": ["Cancer"],
    "muscul": ["Musculoskeletal"],
    "mental": ["Mental Health"],
    "diab": ["Diabetes"],
    "disability": ["Disability"],
    "other": ["AoD", "CKD", "Oral"],
}
ELIGIBLE_CONDITIONS = ["cardio", "respiratory", "muscul"]

# Condition names of the two rosters.
ROSTER_A_CONDITIONS = {
    "cardio": [
        "Chronic Complex- Angina", "Chronic Complex- Cardiovascular (heart) conditions",
        "Chronic Complex- Cholesterol (lipid metabolism disorder)",
        "Chronic Complex- Chronic (congestive) heart failure", "Chronic Complex- Hypertension"],
    "resp": [
        "Chronic Complex- Asthma", "Chronic Complex- Chronic obstructive pulmonary disease (COPD)",
        "Chronic Complex- Respiratory conditions, other"],
    "frailty": [
        "Chronic Complex- Musculo-skeletal conditions, other", "Chronic Complex- Osteoarthritis",
        "Chronic Complex- Osteoporosis", "Chronic Complex- Rheumatoid arthritis"],
}
ROSTER_B_CONDITIONS = {
    "cardio": ["Cardiovascular Disease"],
    "resp": ["Respiratory Disease"],
    "frailty": ["Frailty/Falls Risk"],
}

# Composite outcomes as sums of counts.
COMPOSITES = {
    "gp_face_tele": ["service_tele_pooled", "service_gp_pooled"],
    "md_services": [
        "service_cdm_tca", "service_cdm_mdmp", "service_caseconf", "service_medreview",
        "service_gp_ha", "service_prac_nurse_chronic", "service_cdm_gpmp", "service_cdm_review",
        "service_mhp"],
    "md_services2": [
        "service_cdm_tca", "service_cdm_mdmp", "service_caseconf", "service_medreview",
        "service_gp_ha", "service_prac_nurse_chronic", "service_cdm_review"],
}
# Outcomes, the suffix of their logs, age cut points, link keys and the study's periods.
OUTCOMES = ["gp_face_tele", "referral_number", "md_services", "md_services2", "pres_any"]
LOG_SUFFIX = "_LN"
AGE_CUTS = list(range(15, 111, 5))
LINK_KEYS = ["post_code", "yob", "mob", "sex", "practice_id"]
STUDY_MONTHS = ("2022m1", "2025m9")
STUDY_QUARTERS = ("2022q1", "2025q3")
