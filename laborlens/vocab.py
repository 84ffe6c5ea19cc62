"""Fixed values of the job-market domain: word lists, lookup rows, patterns and messages.

Everything here is data that results depend on.  Operators take these as default
arguments, so a caller can pass other lexicons, rates or messages.
"""

from __future__ import annotations

# --- fixed values: skill lexicon and its categories -------------------------------------
SKILL_LEXICON = (
    # languages
    "python", "sql", "r", "java", "scala", "javascript", "typescript",
    "c++", "c#", "go", "rust", "bash",
    # data and machine learning
    "pandas", "numpy", "scikit-learn", "pytorch", "tensorflow", "keras",
    "xgboost", "lightgbm", "spark", "hadoop", "dbt", "airflow",
    "mlflow", "dvc", "feature engineering", "eda",
    # language processing
    "nlp", "transformers", "hugging face", "langchain", "rag",
    "llm", "openai", "gpt", "bert", "spacy", "nltk",
    # databases
    "postgresql", "mysql", "sqlite", "mongodb", "redis",
    "elasticsearch", "chromadb", "pinecone", "snowflake", "bigquery",
    # cloud and operations
    "aws", "gcp", "azure", "docker", "kubernetes", "terraform",
    "ci/cd", "github actions",
    # reporting
    "power bi", "tableau", "looker", "matplotlib", "seaborn", "plotly", "dash",
    # soft skills
    "communication", "teamwork", "problem solving", "leadership",
    "agile", "scrum",
)

SKILL_CATEGORY = {
    "python": "language", "sql": "language", "r": "language",
    "java": "language", "scala": "language", "javascript": "language",
    "pandas": "data", "numpy": "data", "scikit-learn": "ml",
    "pytorch": "ml", "tensorflow": "ml", "xgboost": "ml",
    "nlp": "nlp", "langchain": "genai", "rag": "genai", "llm": "genai",
    "aws": "cloud", "gcp": "cloud", "azure": "cloud",
    "docker": "devops", "kubernetes": "devops",
    "power bi": "bi", "tableau": "bi", "plotly": "bi",
    "communication": "soft", "teamwork": "soft", "agile": "soft",
}

# --- fixed values: countries and currencies ---------------------------------------------
API_COUNTRY_NAMES = {
    "gb": "United Kingdom", "us": "United States", "au": "Australia", "ca": "Canada",
    "de": "Germany", "fr": "France", "in": "India", "sg": "Singapore", "ae": "UAE",
    "za": "South Africa",
}

DEFAULT_COUNTRY = "default"

# canonical country -> (substrings anywhere in the name, exact codes); tried in this order
COUNTRY_RULES = (
    ("United Kingdom", ("united kingdom",), ("gb", "uk")),
    ("United States", ("united states",), ("us", "usa")),
    ("Egypt", ("egypt",), ("eg",)),
    ("United Arab Emirates", ("uae", "united arab emirates"), ("ae",)),
    ("Saudi Arabia", ("saudi",), ("sa",)),
    ("Kuwait", ("kuwait",), ("kw",)),
)

# canonical country, currency, symbol, scale factor, local units per US dollar
FX_ROWS = (
    ("United Kingdom", "GBP", "£", 1.0, 0.80),
    ("United States", "USD", "$", 1.0, 1.0),
    ("Egypt", "EGP", "E£", 0.08, 50.0),
    ("United Arab Emirates", "AED", "AED ", 1.10, 3.67),
    ("Saudi Arabia", "SAR", "SR ", 0.95, 3.75),
    ("Kuwait", "KWD", "KD ", 1.00, 0.31),
    (DEFAULT_COUNTRY, "USD", "$", 0.80, 1.0),
)

# names under which salaries are held in pounds, and the reporting rate to dollars
POUND_COUNTRIES = ("united kingdom", "gb", "uk")
POUND_TO_USD_REPORT = 1.25
POUND_PER_USD_TRAINING = 0.80
MONTHLY_COUNTRY = "Egypt"
DISPLAY_SYMBOLS = (
    ("£", ("uk", "gb", "united kingdom")),
    ("$", ("us", "usa", "united states")),
    ("E£", ("eg", "egypt")),
)
DISPLAY_SYMBOL_DEFAULT = "£"

# --- fixed values: résumé rules ---------------------------------------------------------
ACTION_VERBS = (
    "designed", "developed", "implemented", "engineered", "led", "managed", "optimized",
    "increased", "improved", "reduced", "accelerated", "architected", "delivered",
    "built", "created", "deployed", "automated", "integrated", "streamlined", "conducted",
    "analyzed", "programmed", "authored", "supervised", "directed", "coordinated",
    "solved", "resolved", "formulated", "executed", "conceptualized",
)

SECTION_WORDS = {
    "experience": ("experience", "employment", "work history", "professional history",
                   "career history", "position", "employment history"),
    "education": ("education", "university", "academic", "college", "degree", "qualification"),
    "skills": ("skills", "technologies", "technical skills", "languages", "expertise",
               "core competencies"),
    "contact": ("contact", "email", "phone", "address", "linkedin", "github", "location"),
}

RESUME_SKILLS = (
    "python", "sql", "r", "java", "c++", "c#", "javascript", "typescript", "html", "css",
    "pytorch", "tensorflow", "keras", "scikit-learn", "pandas", "numpy", "scipy", "matplotlib",
    "seaborn", "spark", "hadoop", "aws", "azure", "gcp", "docker", "kubernetes", "git", "github",
    "tableau", "power bi", "excel", "mlops", "langchain", "llama", "chromadb", "mongodb",
    "postgresql", "mysql", "oracle", "django", "flask", "fastapi", "linux", "bash", "devops",
    "ci/cd", "jenkins",
)
UPPERCASE_SKILLS = ("sql", "aws", "gcp", "css", "html", "mlops", "ci/cd", "bi", "r", "usd", "gbp")
SPECIAL_CASE_SKILLS = {
    "pytorch": "PyTorch", "tensorflow": "TensorFlow", "scikit-learn": "scikit-learn",
    "power bi": "Power BI",
}

METRIC_SIGNS = ("%", "+", "$", "£")
METRIC_UNITS = ("usd", "gbp", "years", "million", "k", "x")

SECTION_NAMES_AR = {
    "experience": "الخبرات المهنية (Experience)",
    "education": "التعليم والدراسة (Education)",
    "skills": "المهارات التقنية (Skills)",
    "contact": "معلومات الاتصال (Contact Info)",
}

# advice texts by language; "{sections}" is replaced by the list of missing sections
ADVICE = {
    "en": {
        "empty": "Resume text is empty. Please check your file.",
        "sections": "Add explicit headings for missing sections: {sections}.",
        "verbs": "Use more strong professional action verbs (e.g. 'designed', 'optimized', 'automated') at the start of your bullet points.",
        "metrics": "Quantify your achievements with numbers, percentages, or scale metrics (e.g., 'improved query performance by 40%').",
        "skills": "List more technical skills and technologies relevant to your job target (e.g. Python, SQL, Docker).",
        "short": "Your resume is too brief. Expand on your project experience and responsibilities (aim for at least 300 words).",
        "long": "Your resume is excessively long. Condense formatting to keep it within 1-2 pages (aim for under 1000 words).",
        "fine": "Ensure your CV is saved in PDF or DOCX format and avoids complex table nesting or sidebar column splits.",
        "extra": "Avoid placing essential contact info inside page headers or footers, as some ATS parsers ignore those areas.",
    },
    "ar": {
        "empty": "ملف السيرة الذاتية فارغ. يرجى التأكد من محتوى الملف.",
        "sections": "يا ريت تضيف عناوين واضحة للأقسام الناقصة دي: {sections}.",
        "verbs": "زود شوية أفعال حركية قوية (زي: صممت، طورت، أتمتت، حسّنت) في بداية نقط شرح مسؤولياتك عشان تبرز دورك.",
        "metrics": "حاول توضح إنجازاتك بالأرقام والنسب المئوية (مثلاً: 'حسّنت سرعة قواعد البيانات بنسبة 40%' أو 'قدت فريق من 4 أفراد').",
        "skills": "ضيف مهارات وأدوات تقنية أكتر بتستخدمها في مجالك (زي: Python, SQL, Docker) في قسم المهارات.",
        "short": "السيرة الذاتية بتاعتك قصيرة شوية، حاول تكتب تفاصيل أكتر عن مشاريعك السابقة ومسؤولياتك عشان الـ ATS يفهم خبرتك.",
        "long": "السيرة الذاتية طويلة زيادة عن اللزوم، حاول تلخصها عشان متزيدش عن صفحتين وتبان مرتبة أكتر لبرامج الفحص.",
        "fine": "سيرتك الذاتية ممتازة! تأكد دائمًا من حفظها بصيغة PDF وتجنب استخدام الجداول المعقدة أو الأعمدة المتعددة.",
        "extra": "بلاش تحط معلومات الاتصال المهمة جوة الـ Header أو الـ Footer لأن بعض برامج الـ ATS بتتجاهل المساحات دي.",
    },
}
EMPTY_RESUME_SUMMARY = {"en": "Empty resume file provided.", "ar": "ملف سيرة ذاتية فارغ."}
SECTION_JOINER = {"en": ", ", "ar": " و "}

# --- fixed values: upload guard ---------------------------------------------------------
UPLOAD_EXTENSIONS = ("pdf", "docx")
UPLOAD_MAX_BYTES = 5 * 1024 * 1024
UPLOAD_REASONS = {
    "extension": "Invalid file extension. Only PDF and DOCX files are allowed.",
    "size": "File is too large. Maximum size allowed is 5MB.",
    "unreadable": "Failed to extract text from the uploaded CV.",
}

# --- fixed values: labels of enumerated values, by language -----------------------------
LABEL_ROWS = (
    ("en", "remote", "Remote"), ("ar", "remote", "عن بُعد"),
    ("en", "hybrid", "Hybrid"), ("ar", "hybrid", "هجين"),
    ("en", "onsite", "On-site"), ("ar", "onsite", "من الموقع"),
    ("en", "full-time", "Full-time"), ("ar", "full-time", "دوام كامل"),
    ("en", "part-time", "Part-time"), ("ar", "part-time", "دوام جزئي"),
    ("en", "internship", "Internship"), ("ar", "internship", "تدريب عملي"),
    ("en", "junior", "Junior"), ("ar", "junior", "مبتدئ"),
    ("en", "mid", "Mid"), ("ar", "mid", "متوسط"),
    ("en", "senior", "Senior"), ("ar", "senior", "متقدم"),
    ("en", "lead", "Lead"), ("ar", "lead", "رئيس فريق"),
    ("en", "lbl_mo", "mo"), ("ar", "lbl_mo", "شهرياً"),
    ("en", "lbl_yr", "yr"), ("ar", "lbl_yr", "سنوياً"),
)
PREDICTED_LABEL = "ML Predicted"

# --- fixed values: feeds ----------------------------------------------------------------
FEED_LOCATIONS = {
    "bayt": ("Egypt", "Cairo", "Saudi Arabia"),
    "indeed": ("Egypt", "Saudi Arabia", "UAE", "Kuwait", "Jordan"),
    "google_jobs": ("Egypt", "Cairo Egypt", "Saudi Arabia"),
}
LAST_WORD_FEEDS = ("google_jobs",)   # country = last word of the searched location
BOARD_SITE = "wuzzuf"
BOARD_BASE_URL = "https://wuzzuf.net"
BOARD_COUNTRY = "Egypt"
API_SOURCE = "adzuna"
SOCIAL_SOURCE = "social"
UNKNOWN_COMPANY = "Unknown"
URL_NAMESPACE_HEX = "6ba7b8119dad11d180b400c04fd430c8"   # RFC 4122 URL namespace

# --- fixed values: retrieval context ----------------------------------------------------
NO_CONTEXT = "No active vacancy context matches this query."
MATCH_DISTANCE = 0.85
HISTORY_TURNS = 6

# --- fixed values: stop words -----------------------------------------------------------
# Spark's default English list, as far as its words can be tokens
ENGLISH_STOPWORDS = (
    "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours",
    "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers",
    "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves",
    "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does",
    "did", "doing", "an", "the", "and", "but", "if", "or", "because", "as", "until",
    "while", "of", "at", "by", "for", "with", "about", "against", "between", "into",
    "through", "during", "before", "after", "above", "below", "to", "from", "up", "down",
    "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here",
    "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "can", "will", "just", "don", "should", "now", "cannot", "could",
    "ought", "would",
)
# extra words left out of the term-frequency report
REPORT_STOPWORDS = (
    "the", "and", "for", "with", "you", "will", "our", "are", "this",
    "have", "that", "from", "your", "work", "team", "role", "looking",
    "experience", "skills", "working", "ability", "strong", "good",
    "new", "join", "able", "part", "also", "help", "well", "use",
    "using", "used", "knowledge", "understanding", "excellent",
)
