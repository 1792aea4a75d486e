"""Word lists of the segmenters. Every operator takes its lists as parameters; these are the defaults."""

from __future__ import annotations

# Stems of transmission verbs, in the normalized spelling, in their natural order.
CHAIN_STEMS = (
    'حدثن', 'حدثي', 'حدثه', 'حدثك',
    'اخبرن', 'اخبري', 'اخبره',
    'سمعت', 'سمعن', 'سمعه',
    'انشدن', 'انشدي',
    'انبان', 'انباي',
    'حكين', 'حكيت',
    'بلغن', 'بلغي',
    'رواه', 'روين', 'روان',
    'كتبن', 'كتبي',
    'يقول', 'يروي',
    'ذكرن', 'ذكري',
    'وحدث', 'واخبر', 'وسمعت', 'وسمعن',
    'وانشد', 'وانبا', 'وحكي', 'وبلغ',
    'وروى', 'ورواه',
)
# Fixed value: the quotation verb that ends a header.
QUOTE = 'قال'
# Verbs of a header, in the spelling with hamza.
HEADER_VERBS = (
    'أخبرنا', 'أخبركم', 'أخبره', 'أخبرها',
    'حدثنا', 'حدثكم', 'حدثه', 'حدثها',
    'أنبأنا', 'أنبأكم', 'أنبأه', 'أنبأها',
    'قال', 'قالت', 'قالوا',
    'ذكر', 'ذكرت', 'ذكروا',
)
# What ends a header after its last verb.
HEADER_STOPS = '۔。.،,\n'
#: A surrogate for the Latin test tables.
LATIN_STEMS = ("that", "with", "para", "eaux", "schr", "ment", "thon")
LATIN_QUOTE = "the"
