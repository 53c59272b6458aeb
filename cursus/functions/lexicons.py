"""Word lists of lesson analytics. Every operator takes its lists as arguments; these are the defaults."""

# Exam, grade and intent markers of the channel filter.
EXAM = (
    "bac", "3as", "بكالوريا", "باك", "ثالثة ثانوي", "السنة الثالثة ثانوي", "terminale",
    "3 ثانوي", "السنة 3 ثانوي", "جميع الشعب", "شعب علمية", "شعب أدبية",
    "الأعداد المركبة", "التكامل", "الدوال الأصلية", "النهايات", "الدالة الأسية", "الدالة اللوغاريتمية",
    "التحويلات النقطية", "المتتاليات العددية", "الهندسة في الفضاء",
    "الاتصال العصبي", "المناعة", "التركيب الضوئي", "التحولات الطاقوية",
    "التحولات النووية", "ثنائي القطب RC", "ثنائي القطب RL", "التطورات المهتزة", "القطبية الثنائية",
)
OTHER_GRADES = (
    "1as", "2as", "1 ثانوي", "2 ثانوي", "الاولى ثانوي", "الثانية ثانوي", "للسنة 1 ثانوي", "للسنة 2 ثانوي",
    "لسنة 1 ثانوي", "لسنة 2 ثانوي", "السنة 1 ثانوي", "السنة 2 ثانوي", "سنة أولى ثانوي", "سنة ثانية ثانوي",
    "أولى ثانوي", "ثانية ثانوي", "متوسط", "bem", "1am", "2am", "3am", "4am", "ابتدائي",
)
STRONG_INTENT = (
    "مراجعة بكالوريا", "تحضير بكالوريا", "تصحيح بكالوريا", "موضوع بكالوريا", "حل موضوع بكالوريا",
    "bac blanc", "révision bac", "corrigé bac", "sujet bac",
)

# Markers of the text and transcript features.
EXAM_MARKERS = (
    "bac", "3as", "بكالوريا", "باك", "ثالثة ثانوي", "السنة الثالثة ثانوي", "terminale",
    "3 ثانوي", "السنة 3 ثانوي", "جميع الشعب", "شعب علمية", "شعب أدبية",
    "مراجعة بكالوريا", "تحضير بكالوريا", "تصحيح بكالوريا", "موضوع بكالوريا", "حل موضوع بكالوريا",
    "bac blanc", "révision bac", "corrigé bac", "sujet bac",
)
TEACHING = (
    "شرح", "درس", "ملخص", "تمرين", "حل", "فهم", "cours", "explication", "résumé", "exercice", "solution",
    "how to", "tutorial", "lesson", "summary", "explained",
)
EXAM_FOCUS = ("bac", "exam", "examen", "2024", "2025", "revision", "exercise", "تمرين", "امتحان", "باك")
PAGE_CODE = ("window.", "ytcfg", "u003d", "u0026", "javascript", "var ", "function(", "<html", "innertubeapi", "commandu0026")
EXAMPLES = ("example", "for instance", "such as", "like", "suppose", "imagine", "مثال", "مثلا", "par exemple", "comme", "prenons")
EXPLANATIONS = ("because", "therefore", "thus", "since", "as a result", "so", "لأن", "إذن", "لذلك", "parce que", "donc", "ainsi", "car")
CONTRASTS = ("however", "but", "although", "instead", "on the other hand", "لكن", "ولكن", "بينما", "mais", "cependant", "toutefois")
TECHNICAL = (
    "theorem", "proof", "formula", "equation", "function", "derivative", "integral", "théorème", "formule",
    "équation", "fonction", "نظرية", "برهان", "معادلة", "دالة",
)

# Title and description keywords whose lift is reported, and those of the quick tips.
TITLE_KEYWORDS = (
    "باك", "bac", "حل", "تمرين", "ملخص", "شرح", "درس", "سهل", "بسيط", "مفصل", "شامل", "مراجعة", "امتحان",
    "2024", "2023", "2025", "رقم", "الجزء",
)
DESCRIPTION_KEYWORDS = ("باك", "bac", "امتحان", "رابط", "تمارين", "حلول", "ملخص", "شرح", "تابعوني", "اشتركوا")
TIP_KEYWORDS = ("باك", "bac", "حل", "تمرين", "ملخص", "شرح", "امتحان")

# Subjects, their aliases and curricula.
SUBJECTS = ("Arabic", "English", "French", "History & Geography", "Islamic Sciences", "Maths", "Natural Sciences", "Philosophy", "Physics")
ALIASES = {
    "math": "Maths", "mathematics": "Maths", "science": "Natural Sciences", "sciences": "Natural Sciences",
    "history": "History & Geography", "geography": "History & Geography", "islamic studies": "Islamic Sciences",
}
CURRICULA = {
    "Maths": (
        "الأعداد المركبة", "التكامل", "الدوال الأصلية", "النهايات", "الدالة الأسية", "الدالة اللوغاريتمية",
        "التحويلات النقطية", "المتتاليات العددية", "الهندسة في الفضاء", "الاشتقاقية", "الاستمرارية", "حساب التكامل",
        "التزايد المقارن", "fonction", "dérivée", "intégrale", "limite", "équation", "complexe", "logarithme",
        "exponentielle", "suite", "géométrie",
    ),
    "Physics": (
        "التحولات النووية", "ثنائي القطب RC", "ثنائي القطب RL", "التطورات المهتزة", "مفهوم الموجة", "تطور جملة ميكانيكية",
        "ظواهر كهربائية", "تحول كيميائي", "المتابعة الزمنية", "force", "énergie", "momentum", "vitesse", "onde",
        "nucléaire", "électrique", "mécanique", "chimique",
    ),
    "Natural Sciences": (
        "الاتصال العصبي", "المناعة", "التركيب الضوئي", "التحولات الطاقوية", "بيكرت البروتين", "التحفيز الأنزيمي",
        "التكتونية", "التخصص الوظيفي للبروتينات", "الدور في الدفاع عن الذات", "البنية الداخلية للأرض", "النشاط التكتوني",
        "molécule", "cellule", "organisme", "réaction", "évolution", "photosynthèse", "protéine", "enzyme", "immunité",
        "neuronal",
    ),
    "History & Geography": (
        "القطبية الثنائية", "الصراع بين الشرق والغرب", "الجزائر 1919", "الجزائر 1989", "العالم الثالث", "الأزمات الدولية",
        "bipolaire", "guerre froide", "décolonisation", "indépendance", "الاقتصاد العالمي", "القوى الاقتصادية الكبرى",
        "الاقتصاد والتنمية", "دول الجنوب", "économie mondiale", "puissances économiques", "développement",
    ),
    "Philosophy": (
        "فلسفة العلوم", "الإشكالية", "السؤال والإشكالية", "العلاقات بين الناس", "انطباق الفكر", "philosophie",
        "problématique", "éthique", "logique",
    ),
    "Islamic Sciences": ("القرآن الكريم", "الحديث الشريف", "العقيدة والفكر", "الفقه وأصوله", "السيرة والهداية"),
}
