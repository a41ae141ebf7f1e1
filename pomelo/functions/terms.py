"""Word lists."""

# Words that place a business in the health domain.
DOMAIN_WORDS = ("health", "medical")

# Fragments that mark one category as medical.
MEDICAL_FRAGMENTS = (
    "acupuncture", "addiction", "allergist", "alternative medicine", "anesthesiol",
    "animal assisted therapy", "animal physical therapy", "audiologist", "ayurveda",
    "behavior analyst", "blood", "plasma", "body contouring", "cannabis clinic",
    "cannabis collective", "cannabis dispensar", "cardio", "cardiolog", "care",
    "chiropract", "clinic", "colonics", "concierge medicine", "cosmetic surgeon",
    "cosmetic dentist", "counseling", "mental health", "cpr", "crisis pregnancy",
    "cryotherapy", "dental", "dentist", "dermatolog", "diagnostic", "dialysis",
    "dietitian", "doctor", "doula", "drugstore", "pharmacy", "ear nose", "emt",
    "emergency", "endocrinolog", "endodontist", "esthetician", "eyebrow", "eyelash",
    "eyewear", "optician", "family practice", "fertility", "first aid", "fitness",
    "float spa", "foot care", "gastroenterolog", "general dentistry", "gerontolog",
    "gynecolog", "hair loss", "hair removal", "halotherapy", "halfway house", "health",
    "hearing", "herbal", "holistic", "home health", "hospice", "hospital", "hypnosis",
    "hypnotherapy", "immunolog", "infusion", "lab", "laser", "laser hair", "massage",
    "medical", "meditation", "mental", "midwife", "naturopath", "nephrol", "neurolog",
    "nurse", "nursing", "nutritionist", "nutrition", "obstetr", "oncolog",
    "ophthalmolog", "optometrist", "oral", "orthodont", "orthoped", "osteopath",
    "pain management", "pediatr", "physical therapy", "physiother", "pilates",
    "plastic surgeon", "podiatrist", "psychiatr", "psycholog", "psychotherap",
    "pulmonolog", "radiol", "rehabilitation", "rheumatolog", "sexual health",
    "skin care", "sleep", "speech therapist", "sports medicine", "surgeon", "surgery",
    "therapy", "traditional chinese", "urology", "urgent care", "vaccine", "vein",
    "vision", "weight loss", "wellness", "wound care", "yoga", "yoga studio",
)

# Categories that contain a fragment above but are not medical.
NOT_MEDICAL = (
    "laser tag", "nurseries & gardening", "floral designers", "florists",
    "flowers & gifts", "career counseling", "child care & day care", "aerial fitness",
)
