"""Skills with points and thresholds, caps, gates and other fixed values of scoring."""
from __future__ import annotations

# Key, id, name, points, category, threshold.
SKILLS = (
    ("full_court_shot", "FCS", "Full-Court Shot", 5.0, "highlight", 0.45),
    ("slam_dunk", "SD", "Slam Dunk", 4.25, "highlight", 0.35),
    ("half_court_shot", "HCS", "Half-Court Shot", 3.75, "highlight", 0.35),
    ("alley_oop", "ALY", "Alley-Oop", 3.5, "highlight", 0.35),
    ("and_1", "AND1", "And-1", 3.25, "highlight", 0.4),
    ("fast_break", "FB", "Fast Break", 3.0, "highlight", 0.35),
    ("three_pointer", "3PT", "3-Pointer", 2.85, "highlight", 0.35),
    ("euro_step", "ES", "Euro Step", 2.75, "highlight", 0.35),
    ("steal", "STL", "Steal / Rebuttal", 2.5, "highlight", 0.4),
    ("crossover", "CO", "Crossover", 2.25, "highlight", 0.35),
    ("hook_shot", "HS", "Hook Shot", 2.0, "highlight", 0.35),
    ("out_the_gate", "OGR", "Out-the-Gate Run", 2.0, "highlight", 0.4),
    ("fourth_quarter", "4QP", "Fourth-Quarter Push", 2.0, "highlight", 0.4),
    ("spin_move", "SPM", "Spin Move", 1.9, "highlight", 0.4),
    ("post_move", "PM", "Post Move", 1.75, "highlight", 0.4),
    ("pick_and_roll", "PNR", "Pick & Roll", 1.65, "highlight", 0.4),
    ("isolation", "ISO", "Isolation", 1.5, "highlight", 0.4),
    ("breakaway", "BKW", "Breakaway", 1.4, "highlight", 0.4),
    ("midrange", "MR", "Mid-Range", 1.35, "highlight", 0.4),
    ("layup", "LU", "Layup", 1.25, "highlight", 0.4),
    ("rebound", "REB", "Rebound", 1.15, "highlight", 0.4),
    ("no_look_pass", "NLP", "No-Look Pass", 0.9, "highlight", 0.4),
    ("floater", "FL", "Floater", 0.75, "highlight", 0.35),
    ("offensive_foul", "OFT", "Offensive Foul", -0.5, "mistake", 0.55),
    ("carry", "CAR", "Carry", -1.0, "mistake", 0.55),
    ("backcourt_violation", "DRG", "Backcourt Violation", -1.25, "mistake", 0.5),
    ("forced_angle", "FA", "Charge / Forced Angle", -1.35, "mistake", 0.5),
    ("travel", "TVL", "Travel / Stumble", -1.5, "mistake", 0.5),
    ("double_dribble", "DD", "Double Dribble", -2.0, "mistake", 0.5),
    ("choke", "CHK", "Turnover / Choke", -2.75, "mistake", 0.5),
    ("out_of_bounds", "OOB", "Out of Bounds", -2.25, "foul", 0.6),
    ("technical_foul", "TECH", "Technical Foul", -3.0, "foul", 0.65),
    ("physical_contact", "PC", "Defensive Foul", -3.0, "foul", 0.7),
    ("goaltending", "GTD", "Goaltending", -3.5, "foul", 0.6),
    ("boundary_violation", "BV", "Boundary Violation", -4.0, "foul", 0.7),
)

IDS = {key: skill_id for key, skill_id, *_ in SKILLS}
#: Thresholds that hold where a caller names none; a skill's own threshold holds where it is larger.
POSITIVE, NEGATIVE = 0.4, 0.5

# How often a skill may be kept in a round of 45 lines, and skills whose cap doesn't grow with the round.
CAPS = {
    "FCS": 1, "OGR": 1, "4QP": 1, "SD": 1, "HCS": 1, "ALY": 2, "AND1": 2, "FB": 2, "ES": 2, "STL": 3, "SPM": 1, "CO": 1, "HS": 1,
    "3PT": 2, "PM": 1, "ISO": 1, "BKW": 1, "MR": 2, "LU": 1, "FL": 2, "REB": 2, "NLP": 2, "DRG": 2, "FA": 2, "CAR": 2, "OFT": 2,
}
STRUCTURAL = ("FCS", "OGR", "4QP", "SD", "HCS", "SPM", "PM", "BKW")
NO_CAP = 99
GATED = ("ES", "FCS", "SPM", "STL")
TRUSTED = ("DD", "TVL", "CHK")
SELF_CORRECTION = ("no it's", "no it is", "no wait", "i mean", "actually it's", "actually it is")
SWAP = ("naked", "nathan", "bacon")
TECHNIQUES = (
    ("full_court_shot", "Full-Court Shot", "+5.0 Points", "High-risk, high-reward bar: an unexpected knockout"),
    ("slam_dunk", "Slam Dunk", "+4.25 Points", "Concussive knockout bar with instant explosive reaction"),
    ("half_court_shot", "Half-Court Shot", "+3.75 Points", "Creative risk that lands with a perfect finish"),
    ("alley_oop", "Alley-Oop/Assist", "+3.5 Points", "Multi-person coordination and team collaboration"),
)
WINDOW, OVERLAP, TIE = 10, 3, 0.75


def threshold(points: float, own: float, positive: float = POSITIVE, negative: float = NEGATIVE) -> float:
    return max(negative if points < 0 else positive, own)
