"""One-call detection: a small model trained on first use from sentences that come with the package."""

from __future__ import annotations

from functools import lru_cache

from .operators.detect import Detection, detect_bytes
from .operators.model import Linear, fit_objects

#: A few plain sentences and the encodings, besides the Unicode ones, that texts like them are found in.
SENTENCES = {
    "Die Straße führt über die große Brücke. Für Grüße aus München hätte er später Zeit. Möchten Sie ein Stück Käse und süße Brötchen?": ("cp1252", "cp437", "mac_roman"),
    "L'été dernier, ma sœur a reçu une très belle lettre à l'hôtel. Où êtes-vous allés après le déjeuner? Ça m'étonne beaucoup.": ("cp1252", "cp437", "mac_roman"),
    "El niño comió una manzana por la mañana. ¿Dónde está la estación más próxima? Mañana viajará el señor Muñoz según el guión.": ("cp1252", "cp437", "mac_roman"),
    "Příliš žluťoučký kůň úpěl ďábelské ódy. Děkuji za večeři, zítra přijdu později. Můžete mi říct, kde je nádraží?": ("cp1250", "iso8859-2"),
    "Zażółć gęślą jaźń. Proszę podać mi książkę, która leży na stole. Dziękuję za pomoc, do zobaczenia później w święta.": ("cp1250", "iso8859-2"),
    "Съешь ещё этих мягких французских булок, да выпей чаю. Завтра утром мы поедем в город, чтобы купить новые книги и хлеб.": ("cp1251", "koi8-r", "iso8859-5", "cp866"),
    "Η γρήγορη καφέ αλεπού πηδάει πάνω από το σκυλί. Αύριο θα πάμε στην πόλη για να αγοράσουμε βιβλία και ψωμί.": ("cp1253", "iso8859-7"),
    "Pijamalı hasta yağız şoföre çabucak güvendi. Yarın sabah şehre gidip yeni kitaplar ve ekmek alacağız, öğleden sonra döneriz.": ("cp1254",),
    "נראה שמחר יהיה יום יפה ונצא לטייל בעיר. קנינו ספרים חדשים ולחם טרי בשוק, ואחר כך חזרנו הביתה.": ("cp1255",),
    "سنذهب غدا إلى المدينة لشراء كتب جديدة وخبز طازج من السوق ثم نعود إلى البيت بعد الظهر إن شاء الله.": ("cp1256",),
    "明日の朝、私たちは町へ行って新しい本とパンを買います。駅はどこですか。ありがとうございます、また来てください。": ("shift_jis", "euc_jp", "iso2022_jp"),
    "明天早上我们去城里买新书和面包。请问火车站在哪里？谢谢你的帮助，下次再见，祝你一切顺利。": ("gb18030",),
    "明天早上我們去城裡買新書和麵包。請問火車站在哪裡？謝謝你的幫助，下次再見，祝你一切順利。": ("big5",),
    "내일 아침 우리는 도시에 가서 새 책과 빵을 살 것입니다. 역이 어디에 있습니까? 도와주셔서 감사합니다. 다음에 또 뵙겠습니다.": ("cp949",),
}
UNICODE = ("utf-8", "utf-8-sig", "utf-16-le", "utf-16-be", "utf-32-le", "utf-32-be")


@lru_cache(maxsize=1)
def default_model() -> Linear:
    """Windows of words of each sentence in each encoding; takes about a second, once."""
    data = set()
    for text, legacy in SENTENCES.items():
        words = text.split() if " " in text else list(text)
        joint = " " if " " in text else ""
        for label in (*legacy, *UNICODE):
            for k in range(0, len(words), 3):
                part = joint.join((words[k:] + words[:k])[: 6 + k % 9 * 2])
                data.add((part.encode(label, "ignore"), label))
    once: dict[bytes, str] = {}
    for raw, label in sorted(data):
        once.setdefault(raw, label)
    return fit_objects(sorted(once.items()), epochs=20)


def detect(raw: bytes | bytearray | memoryview, bom_policy: str = "strip") -> Detection:
    """Encoding, text and how certain they are, of one object."""
    if not isinstance(raw, (bytes, bytearray, memoryview)):
        raise TypeError("detect takes bytes, bytearray or memoryview")
    return detect_bytes(bytes(raw), default_model(), bom_policy=bom_policy)


def decode(raw: bytes | bytearray | memoryview, bom_policy: str = "strip") -> str:
    """The text of one object; ValueError if no encoding reads all of it."""
    found = detect(raw, bom_policy)
    if not found.accepted:
        raise ValueError(f"can't decode: {found.reason}")
    return found.text
