"""Word lists of the text analytics."""

# fixed values: sentiment words, English
POSITIVE_EN = [
    "good", "great", "excellent", "amazing", "wonderful", "fantastic", "love", "best", "happy", "perfect", "beautiful", "awesome", "nice",
    "like", "recommend", "satisfied", "helpful", "quality",
]
NEGATIVE_EN = [
    "bad", "terrible", "horrible", "awful", "worst", "hate", "poor", "disappointed", "waste", "useless", "broken", "problem", "issue",
    "fail", "never", "wrong", "slow", "expensive",
]

# fixed values: sentiment words, Arabic
POSITIVE_AR = [
    "ممتاز", "رائع", "جيد", "حلو", "جميل", "سعيد", "مبسوط", "أفضل", "أحسن", "عظيم", "راضي", "سريع", "نظيف",
]
NEGATIVE_AR = [
    "سيء", "مشكلة", "بطيء", "غالي", "زعلان", "خايب", "ضعيف", "سبب", "تأخير", "إلغاء", "فشل", "خطأ",
]

# fixed values: stop words, English
STOP_EN = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "this", "that",
    "these", "those", "i", "you", "he", "she", "it", "we", "they", "what", "which", "who", "when", "where", "why", "how",
]

# fixed values: stop words, Arabic
STOP_AR = [
    "في", "من", "على", "إلى", "عن", "مع", "هذا", "هذه", "ذلك", "التي", "الذي", "هو", "هي", "نحن", "أنت", "هم", "كان", "كانت", "يكون", "أن",
    "لا", "ما", "قد", "و", "أو", "ثم", "لكن",
]
