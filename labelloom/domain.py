"""Closed lists of the energy-mail domain and defaults of the classification runs."""

from __future__ import annotations

# The 35 labels in matrix order, each with its generation weight
# and its description.
CLASSES = [
    ("factura_error", 0.08, "El cliente reporta un error en el importe, fechas o conceptos de su factura eléctrica o de gas"),
    ("corte_suministro", 0.07, "Aviso o queja sobre un corte de suministro eléctrico o de gas, ya sea programado o por impago"),
    ("alta_consumo_anomalo", 0.06, "El cliente detecta un consumo inusualmente alto que no corresponde a su uso habitual"),
    ("solicitud_cambio_tarifa", 0.06, "Petición para cambiar a otra tarifa eléctrica (PVPC, tarifa fija, discriminación horaria, etc.)"),
    ("averia_contador", 0.05, "Reporte de contador roto, con lectura incorrecta o que no funciona correctamente"),
    ("solicitud_nuevo_contrato", 0.04, "Solicitud para dar de alta un nuevo contrato de luz o gas en un domicilio o local"),
    ("baja_contrato", 0.04, "Solicitud de cancelación o baja del contrato de suministro energético"),
    ("cambio_titular", 0.04, "Petición para cambiar el titular del contrato (herencia, compraventa, divorcio, etc.)"),
    ("reclamacion_factura", 0.04, "Reclamación formal sobre el cobro incorrecto de conceptos en la factura"),
    ("consulta_autoconsumo", 0.04, "Preguntas sobre instalación de placas solares, autoconsumo compartido o vertido a red"),
    ("instalacion_solar", 0.03, "Consulta o solicitud de información sobre instalación de paneles fotovoltaicos"),
    ("consulta_tarifas_pvpc", 0.03, "Preguntas sobre el Precio Voluntario al Pequeño Consumidor y precios de mercado"),
    ("fraude_energetico", 0.03, "Denuncia o sospecha de fraude en el suministro, enganche ilegal o manipulación de contador"),
    ("emergencia_gas", 0.03, "Situación de emergencia relacionada con gas: olor a gas, posible fuga, explosión"),
    ("fuga_gas", 0.03, "Detección o sospecha de fuga de gas en instalación doméstica o industrial"),
    ("consulta_eficiencia", 0.025, "Preguntas sobre cómo reducir el consumo energético y mejorar la eficiencia del hogar"),
    ("programa_fidelizacion", 0.025, "Consulta o queja sobre puntos, descuentos o beneficios del programa de fidelización"),
    ("solicitud_aplazamiento", 0.025, "Petición para aplazar o fraccionar el pago de una factura pendiente"),
    ("incidencia_apagón", 0.025, "Reporte de apagón o microinterrupción en la zona o edificio del cliente"),
    ("cambio_domiciliacion", 0.02, "Solicitud de cambio de cuenta bancaria para el cargo de las facturas"),
    ("factura_duplicada", 0.02, "El cliente ha recibido dos facturas del mismo período o un cobro duplicado"),
    ("consulta_lectura_contador", 0.02, "Preguntas sobre cómo leer el contador, enviar lectura o interpretar los datos"),
    ("bono_social", 0.02, "Consulta o solicitud relacionada con el bono social eléctrico para hogares vulnerables"),
    ("contrato_empresarial", 0.02, "Gestión de contratos de suministro para empresas, polígonos industriales o grandes consumidores"),
    ("vehiculo_electrico", 0.02, "Preguntas sobre tarifas especiales, puntos de recarga o instalación de cargador para vehículo eléctrico"),
    ("reclamacion_calidad", 0.015, "Queja sobre la calidad del suministro: fluctuaciones de tensión, micro-cortes frecuentes"),
    ("denuncia_proveedor", 0.015, "Denuncia formal contra la comercializadora por prácticas abusivas o incumplimiento contractual"),
    ("phishing_energia", 0.01, "El cliente ha recibido un correo o llamada fraudulenta suplantando a la empresa energética"),
    ("newsletter", 0.01, "Boletín informativo de la empresa enviado al cliente"),
    ("oferta_comercial", 0.01, "Comunicación comercial con ofertas, promociones o nuevas tarifas"),
    ("respuesta_automatica", 0.01, "Respuesta automática del sistema o de un cliente ausente de la oficina"),
    ("spam_energia", 0.01, "Correo no deseado relacionado con servicios energéticos de terceros"),
    ("solicitud_certificado", 0.01, "Petición de certificado de consumo, contrato o instalación para trámites administrativos"),
    ("consulta_juridica", 0.01, "Consulta sobre aspectos legales del contrato, LOPD, o reclamaciones ante organismos reguladores"),
    ("otro_irrelevante", 0.005, "Correo que no tiene relación con servicios energéticos o está fuera del dominio"),
]

# Label variants seen in free-form answers, and the label meant.
LABEL_ALIASES = {
    "solicitud_autoconsumo": "consulta_autoconsumo",
    "autoconsumo": "consulta_autoconsumo",
    "consulta_autoconsumo_solar": "consulta_autoconsumo",
    "solicitud_instalacion_solar": "instalacion_solar",
    "instalacion_fotovoltaica": "instalacion_solar",
    "placas_solares": "instalacion_solar",
    "error_factura": "factura_error",
    "factura_incorrecta": "factura_error",
    "error_en_factura": "factura_error",
    "reclamacion": "reclamacion_factura",
    "reclamacion_cobro": "reclamacion_factura",
    "cambio_tarifa": "solicitud_cambio_tarifa",
    "cambio_de_tarifa": "solicitud_cambio_tarifa",
    "corte": "corte_suministro",
    "corte_luz": "corte_suministro",
    "corte_gas": "corte_suministro",
    "consumo_anomalo": "alta_consumo_anomalo",
    "consumo_elevado": "alta_consumo_anomalo",
    "consumo_alto": "alta_consumo_anomalo",
    "baja": "baja_contrato",
    "cancelacion_contrato": "baja_contrato",
    "baja_de_contrato": "baja_contrato",
    "alta_contrato": "solicitud_nuevo_contrato",
    "nuevo_contrato": "solicitud_nuevo_contrato",
    "alta_suministro": "solicitud_nuevo_contrato",
    "coche_electrico": "vehiculo_electrico",
    "recarga_electrica": "vehiculo_electrico",
    "punto_recarga": "vehiculo_electrico",
    "phishing": "phishing_energia",
    "fraude_comunicacion": "phishing_energia",
    "apagon": "incidencia_apagón",
    "incidencia_apagon": "incidencia_apagón",
    "microinterrupcion": "incidencia_apagón",
    "fuga": "fuga_gas",
    "olor_gas": "emergencia_gas",
    "emergencia": "emergencia_gas",
}

# Plan dimensions with their weights and wording hints.
TONES = ["formal", "informal", "urgente", "agresivo", "técnico", "confuso", "cortés", "desesperado"]
SENDER_PROFILES = [
    "cliente_residencial", "cliente_empresarial", "abogado", "jubilado", "autónomo", "particular_enfadado",
]
CHANNELS = ["webform", "email_directo", "app_movil", "reenvio_tercero", "respuesta_cadena"]
LENGTH_WEIGHTS = [("muy_corto", 0.10), ("corto", 0.25), ("medio", 0.35), ("largo", 0.20), ("muy_largo", 0.10)]
NOISE_WEIGHTS = [("limpio", 0.40), ("leve", 0.30), ("moderado", 0.20), ("alto", 0.10)]
LENGTH_HINTS = {
    "muy_corto": "30-60", "corto": "80-130", "medio": "150-250", "largo": "280-400", "muy_largo": "450-600",
}
NOISE_HINTS = {
    "limpio": "ninguno, texto correcto y profesional",
    "leve": "algún acento faltante o puntuación descuidada",
    "moderado": "errores tipográficos, frases cortadas, mayúsculas al azar",
    "alto": "faltas de ortografía graves, lenguaje muy informal, texto difícil de leer",
}
SPAM_CLASSES = [
    "spam_energia", "otro_irrelevante", "newsletter",
    "oferta_comercial", "respuesta_automatica", "phishing_energia",
]
DEFAULT_CLASS_HINT = "Correo del sector energético"
DEFAULT_LENGTH_HINT = "150-250"
DEFAULT_NOISE_HINT = "leve"

# Ratios, limits and seeds of the runs.
SEED = 42
MULTI_INTENT_RATIO = 0.20
AMBIGUOUS_RATIO = 0.15
SPAM_RATIO = 0.08
TEST_FRACTION = 0.30
MAX_BODY_CHARS = 3000
MAX_EXAMPLE_CHARS = 400
BODY_MARKER = " [TEXTO TRUNCADO]"
EXAMPLE_MARKER = " [...]"
SHRINK_MARKER = " [TRUNCADO]"
MAX_TERMS = 20_000
FALLBACK_LABEL = "otro_irrelevante"
NO_SUBJECT = "[Sin asunto]"
FAILED_BODY = "[Generación fallida]"
FAILED_REASONING = "[Generación fallida - tokens agotados en razonamiento]"
FAILED_FORMAT = "[Generación fallida - sin formato válido]"

LABELS = [name for name, _, _ in CLASSES]
DESCRIPTIONS = {name: text for name, _, text in CLASSES}
WEIGHTS = [(name, weight) for name, weight, _ in CLASSES]
