"""Function words removed before indexing: English and Spanish together, whatever the language of the text.

Fixed values, in natural order. Some Spanish ones are also English words (``con``, ``era``, ``sin``); that is kept.
"""

ENGLISH = tuple(
    """
    a about above after again against all am an and any are as at be because been before being below between both but
    by can could did do does doing down during each few for from further had has have having he her here hers herself
    him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or
    other our ours ourselves out over own same she should so some such than that the their theirs them themselves then
    there these they this those through to too under until up very was we were what when where which while who whom why
    will with won would you your yours yourself yourselves
    """.split()
)

SPANISH = tuple(
    """
    al algo algunas algunos ante antes como con contra cual cuando de del desde donde durante e el ella ellas ellos en
    entre era erais eran eras eres es esa esas ese eso esos esta estaba estado estar estas este esto estos estoy está
    fue fueron fui ha han has hasta hay he la las le les lo los me mi mis mucho muchos muy más mí mía mío nada ni no nos
    nosotros nuestra nuestro o os otra otras otro otros para pero poco por porque que quien quienes qué se sea sean ser
    si sido sin sobre sois somos son soy su sus suya suyo sí también tanto te tengo ti tiene tienen todo todos tu tus
    tuve tuya tuyo tú un una uno unos vosotros vuestra vuestro y ya yo él éramos
    """.split()
)

STOP_WORDS = tuple(sorted({*ENGLISH, *SPANISH}))
