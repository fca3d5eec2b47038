"""What announcements in Persian and English are recognised by, as people write it.  These must equal the rules they implement."""

STRONG = (
    "شب بازی", "رویداد", "ایونت", "ورکشاپ", "کارگاه", "افتتاحیه", "نمایشگاه", "کنسرت", "دورهمی", "نشست", "همایش", "جشنواره", "فستیوال", "بازارچه", "اکران", "سمینار", "وبینار", "کنفرانس", "رونمایی",
    "event", "workshop", "exhibition", "concert", "meetup", "conference", "festival", "screening", "webinar", "seminar", "opening night", "opening reception",
)
WEAK = ("اجرا", "تور", "کلاس", "جلسه", "موسیقی زنده", "سخنرانی", "افتتاح", "talk", "class", "live music", "tour", "session", "opening")
WEEKDAYS = (
    "شنبه", "یکشنبه", "یک شنبه", "دوشنبه", "دو شنبه", "سه شنبه", "چهارشنبه", "چهار شنبه", "پنجشنبه", "پنج شنبه", "جمعه",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
)
PERSIAN_MONTHS = ("فروردین", "اردیبهشت", "خرداد", "تیر", "مرداد", "شهریور", "مهر", "آبان", "آذر", "دی", "بهمن", "اسفند")
ENGLISH_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTH_FORMS = tuple(month + tail for month in PERSIAN_MONTHS for tail in ("ماه", " ماه"))
RELATIVE = (
    "امروز", "امشب", "فردا", "فردا شب", "پس فردا", "آخر هفته", "آخر این هفته", "این هفته", "هفته آینده", "هفته جاری", "این جمعه", "این ماه", "ماه آینده", "امسال",
    "today", "tonight", "tomorrow", "this weekend", "next weekend", "this week", "next week",
)
DATES = (*WEEKDAYS, *MONTH_FORMS, *PERSIAN_MONTHS, *ENGLISH_MONTHS, *RELATIVE)
MONTHS_WITH_A_NUMBER = ("دی", "may", "march")
TIMES = ("ساعت", "از ساعت", "تا ساعت")
NUMBER_WORDS = ("یک", "دو", "سه", "چهار", "پنج", "شش", "هفت", "هشت", "نه", "ده", "نیم", "چند")
CLOCKS = (r"\b\d{1,2}(?::\d{2})?\s*[ap]\.?\s*m\.?(?!\w)", r"\b\d{1,2}:\d{2}\b", r"ساعت\s*\d{1,2}", r"\b\d{1,2}\s*(?:am|pm)\b")
NUMERIC_DATE = r"\b\d{1,4}[/\-]\d{1,2}(?:[/\-]\d{1,4})?\b"
PLACES = (
    "گالری", "نگارخانه", "موزه", "فضای هنری", "خانه هنرمندان", "مرکز فرهنگی", "فرهنگسرا", "کافه گالری",
    "gallery", "museum", "art space", "cultural center", "cultural centre", "art center", "art centre",
)
PLACE_CONTEXT = (
    "معرفی گالری", "معرفی موزه", "معرفی", "آشنایی با", "پیشنهاد برای بازدید", "فضایی برای", "یکی از گالری‌های", "یکی از موزه‌های", "ساعات کاری", "ساعت کاری", "ساعات بازدید", "ساعت بازدید", "همه روزه", "هر روز",
    "به جز روزهای تعطیل", "واقع در", "پذیرای شما", "پذیرای بازدیدکنندگان", "بازدید رایگان",
    "opening hours", "open daily", "open every day", "located in", "located at", "visiting hours", "introducing", "discover", "meet the gallery", "a gallery in", "a museum in", "worth visiting",
)
OPENING = ("ساعات کاری", "ساعت کاری", "ساعات بازدید", "ساعت بازدید", "opening hours", "visiting hours")
DAILY = ("همه روزه", "هر روز", "open daily", "open every day")
ATTENDANCE = (
    "منتظرتونن", "منتظرتونیم", "منتظرتون هستیم", "منتظر شما", "منتظر شماییم", "سر بزنید", "سر بزنین", "بیاید", "بیاین", "بیایید", "شرکت کنید", "شرکت کنین", "ثبت نام کنید", "حضور", "حضور به هم رسانید",
    "برگزار می شود", "برگزار میشود", "برگزار میشه", "برگزار می کنیم", "برگزار میکنیم", "میزبان", "همراه ما باشید",
    "join us", "come by", "visit us", "attend", "we are hosting", "takes place", "come join", "save the date",
)
RETROSPECTIVE = (
    "برگزار شد", "برگزار شده", "برگزار گردید", "هفته گذشته", "ماه گذشته", "سال گذشته", "هفته پیش", "ماه پیش", "سال پیش", "پارسال", "گزارش تصویری", "تصاویر رویداد", "عکس های رویداد", "مروری بر", "خاطره", "خاطرات",
    "پشت صحنه", "به پایان رسید", "تمام شد", "تموم شد",
    "last week", "last month", "last year", "behind the scenes", "recap", "throwback", "wrapped up", "came to an end", "was held",
)
REGISTRATION = (
    "ثبت نام", "لینک ثبت نام", "رزرو", "خرید بلیت", "خرید بلیط", "تهیه بلیت", "تهیه بلیط", "بلیت", "بلیط",
    "register", "registration", "booking", "rsvp", "book your spot", "tickets", "ticket", "sign up",
)
PRICES = ("رایگان", "ورودی", "هزینه", "قیمت", "تومان", "ریال", "بدون هزینه", "free", "price", "ticket price", "entry", "fee")
PLACEHOLDERS = (
    "Untitled", "Untitled Event", "Unknown", "Unknown Event", "No Title", "Title Unknown", "N/A", "None", "Null", "TBD", "رویداد بدون عنوان", "بدون عنوان", "عنوان نامشخص", "رویداد نامشخص", "نامشخص",
    "رویداد", "ایونت", "ایونت جدید", "نمایشگاه انفرادی", "کارگاه", "ورکشاپ",
)

#: Words that head a name, and words that a name does not hold.
EVENT_HEADS = ("تور", "شب بازی", "رویداد", "ایونت", "افتتاحیه", "رونمایی", "نمایشگاه", "کارگاه", "ورکشاپ", "کنسرت", "جشنواره", "فستیوال", "همایش", "سمینار", "دورهمی", "اکران", "بازارچه", "نشست")
PLACE_HEADS = ("کافه گالری", "گالری", "نگارخانه", "موزه", "فضای هنری", "مرکز فرهنگی", "فرهنگسرا", "gallery", "museum")
NOT_IN_NAMES = (
    "می", "نمی", "میتوانید", "میتونید", "میتونی", "میشه", "میشود", "میکنیم", "میکنه", "میاد", "دارد", "داره", "دارند", "دارن", "داریم", "است", "هست", "هستش", "هستند", "هستیم", "نیست", "نیستند",
    "بود", "بودند", "باشد", "باشه", "باشید", "شد", "شده", "شود", "گردید", "خواهد", "باید", "توانید", "تونید", "کنید", "کنیم", "برگزار",
    "جزو", "یکی", "یک", "چند", "همه", "هر", "خیلی", "کلی", "بعضی", "تعدادی", "ها", "های", "هایی", "این", "آن", "همین", "همان",
    "که", "برای", "در", "از", "با", "به", "تا", "را", "یا", "و", "هم", "بر", "روی", "طی", "توسط", "بدون", "ما", "شما", "او", "آنها", "اونها", "من", "تو",
    "is", "was", "are", "were", "will", "can", "could", "the", "a", "an", "this", "that", "these", "those", "of", "to", "in", "on", "at", "for", "with", "and", "or", "but", "not",
    "our", "your", "their", "we", "you", "they", "it", "its",
)
FUNCTION_WORDS = (*NOT_IN_NAMES, "اما", "ولی", "پس", "چون", "اگر", "نیز", "so", "if", "then", "because", "as", "by", "from", "into", "out")

#: Patterns of texts that are judged before they are classified.
PAST = r"برگزار (?:شد|کرد)|دعوت کرد|رقم زد|took place|\bhosted\b|\brecap\b|گزارش تصویری"
FUTURE = r"برگزار می|برگزار خواهد|ثبت[\s‌]*نام|رزرو|خرید بلیت|بپیوند|منتظرت|\bregister\b|\bjoin us\b|\bnext\b"
COLLECTION = r"ایونت[\s‌]*های هفته|رویدادهایی رو گرد|کدوم اسلاید|برنامه[\s‌]*های این هفته|تقویم این هفته"
SERIES = r"(?s)هر [اآ]خر هفته.*فیلم.*کتاب.*روانشناس"
SPECIFIC = r"این هفته ایونت\s+فیلم\s+و\s+گفتگو"
PRODUCT = r"فروش محصول|خرید محصول|product sale|product advertisement"
ACTIVITY = r"شرکت[\s‌]*کن|آموزش|برگزار|ساعت|attend|workshop on"
STATED_DATE, YEAR = r"(?:زمان|تاریخ)\s*:", r"\b(?:19|20)[0-9]{2}\b|\b14[0-9]{2}\b"

#: Weights: a first term, each further one, and at most so much for those.
WEIGHTS = {"event_strong": (2.0, 0.5, 1.0), "event_weak": (1.0, 0.0, 0.0), "place_term": (2.0, 0.5, 1.0)}
ONCE = {"named_event": 2.0, "date": 1.5, "time": 1.0, "registration": 1.5, "attendance": 1.0, "price": 0.5}
PLACE_ONCE = {"place_context": 1.5}
AGAINST, THRESHOLD = 2.0, 3.0
