"""Refusals and look-alikes of four languages, in three pairs of lists. Each was written before the rules were measured on
it, and served to widen them after that: recall and precision at first sight were 0.70 and 0.89, 0.70 and 1.0, 0.60 and
1.0. These, not those of the tests, say what refusals in other words can expect."""

REFUSALS = """This question will not be answered.
I'm afraid I can't assist with that request.
No comment.
We would prefer not to respond to this point.
Regrettably the bidder is not in a position to give a response here.
I must respectfully decline.
It would be inappropriate for me to answer this.
I am sorry, but I cannot provide an answer to this requirement.
This requirement is being left blank.
We are choosing not to answer this item.
As an AI model, I cannot make statements about staffing levels.
There is not enough information in the library for me to write a response.
I don't have sufficient evidence to answer this question.
Our policy prevents us from commenting on this.
I can't help with this section.
No response is available for this clause.
The author has declined to reply.
I won't be drafting anything for this question.
This one is best left to a specialist.
I refuse to answer that.
Answering this lies beyond my competence.
We regret that no statement can be made on this point.
I do not feel able to comment on data retention.
Sorry, I am not allowed to discuss pricing.
I have been instructed not to answer questions of this kind.
The material on file does not allow me to answer.
Nothing can be said about this here.
A response could not be produced.
I'd rather leave this one unanswered.
I will have to pass on this question.
Unfortunately it was not possible to prepare a reply.
We cannot respond to this requirement at this time.
I have no basis for writing an answer.
This cannot be answered from what I was given.
My instructions forbid me from drafting commitments.
I am unable to complete this request.
Je regrette, mais je ne suis pas en mesure de répondre.
Nous ne pouvons pas répondre à cette question.
Aucune réponse n'est possible sur ce point.
Je refuse de répondre à cette demande.
Il m'est impossible de rédiger une réponse.
Cette question restera sans réponse.
Je préfère ne pas me prononcer sur ce sujet.
Je n'ai pas assez d'informations pour répondre.
Leider kann ich diese Frage nicht beantworten.
Dazu kann keine Aussage gemacht werden.
Ich möchte mich dazu nicht äußern.
Diese Anforderung bleibt unbeantwortet.
Wir sind nicht in der Lage, hierzu Stellung zu nehmen.
Eine Antwort ist leider nicht möglich.
Mir fehlen die Angaben für eine Antwort.
Ich lehne es ab, darauf zu antworten.
Lo siento, no puedo ayudar con esta solicitud.
No es posible contestar a esta pregunta.
Preferimos no responder a este punto.
No se ofrece respuesta a este requisito.
No dispongo de información para responder.
Este punto queda sin respuesta.
Me niego a contestar.
No estamos en condiciones de dar una respuesta.""".split("\n")

LOOK_ALIKES = """The desk cannot be closed during exam weeks, so two clerks stay on duty.
We will not charge for cancelled visits.
Calls that are not answered within 30 seconds go to the second line.
No call is left unanswered for more than a minute.
Staff who are unable to attend are replaced by the pool on the same day.
We do not use subcontractors for this lot.
The system refuses connections without a certificate.
Our answer to outages is a second power feed.
The service manager declines change requests that lack a rollback plan.
We cannot provide weekend cover in lot 3, but lots 1 and 2 have it.
No data leaves the country.
Requests that cannot be dealt with on the first call are passed to the resolver group.
If a question is outside the remit of the desk, it is sent to the buyer.
Nothing is installed without a signed permit.
We respond to every request within four hours.
The tool will not accept a blank field.
Unfortunately the old lift was beyond repair, so we fitted a new one in May.
Our policy does not allow visitors in the server room.
Our guidelines forbid shared passwords.
Sorry to say we lost two staff in 2021; both posts were filled within six weeks.
Information about outages is published on the portal.
A human reviews each automated decision.
Drafts are reviewed by a second author before they are released.
We have no open audit findings.
No, the licence does not renew by itself.
Yes, but not before March.
Not applicable tests are marked as such in the log.
The pump cannot produce more than 40 litres a minute.
We are not able to move the start date, since the hall opens on 1 June.
The archive is not available at night.
Tenders without a signature cannot be accepted under rule 4.
Complaints are answered in writing within ten days.
We never leave a site without a handover.
The contractor must not write to the live database.
We do not wish to change the agreed price.
We cannot give a discount above five percent.
Help is at hand from seven in the morning.
It is impossible to open the cabinet without two keys.
We give no warranty for third-party parts.
The team could not complete the move in 2020 because of the lockdown; it was done in 2021.
Le service ne peut pas être interrompu pendant les examens.
Nous répondons à chaque demande en deux heures.
Aucune donnée ne quitte le pays.
Les appels sans réponse sont rappelés le jour même.
Nous refusons les livraisons sans bon de commande.
Il est impossible d'ouvrir l'armoire sans deux clés.
Der Dienst kann nicht ohne Freigabe geändert werden.
Jede Anfrage wird innerhalb von zwei Stunden beantwortet.
Keine Daten verlassen das Land.
Anrufe bleiben nie länger als eine Minute offen.
Wir lehnen Lieferungen ohne Bestellnummer ab.
Die Tür lässt sich nicht ohne Schlüssel öffnen.
El servicio no puede interrumpirse durante los exámenes.
Respondemos a cada solicitud en dos horas.
Ningún dato sale del país.
Las llamadas sin respuesta se devuelven el mismo día.
No se puede abrir el armario sin dos llaves.
Rechazamos las entregas sin número de pedido.
No ofrecemos descuentos por encima del cinco por ciento.
La garantía no cubre piezas de terceros.""".split("\n")


SECOND = """We are sorry to say that we have no reply to offer on this matter.
I would prefer to leave the answer to the bid manager.
This falls outside what I can write about.
Please excuse me from answering this one.
I can't write that for you.
It isn't possible for me to give a reply.
We do not intend to reply to this requirement.
I cannot in good conscience draft this commitment.
There is no answer to this in the library.
Answering would require evidence that I lack.
I was unable to put together a response.
We will abstain from commenting.
I'm not able to help you with that.
No statement will be made on this clause.
The bidder chooses not to answer.
Our rules do not allow us to comment on staffing.
I have nothing to offer here.
I must refuse.
The question remains without an answer.
I cannot speculate about future volumes.
A reply to this item cannot be given.
I do not have enough material to draft a passage.
I won't answer that.
This request cannot be fulfilled by me.
Sorry, but this goes beyond my role as a writer.
I decline to provide text for this section.
Je ne souhaite pas répondre.
Nous ne sommes pas en mesure de fournir une réponse.
Désolé, je ne peux pas vous aider.
Il n'y a pas de réponse à cette exigence.
Ich kann darauf nicht antworten.
Es ist uns nicht möglich, eine Antwort zu geben.
Zu diesem Punkt wird keine Stellungnahme abgegeben.
Ich verzichte auf eine Antwort.
No puedo redactar este texto.
Lamentamos no poder responder.
Este requisito no será respondido.
No hay respuesta para este punto.
Declinamos contestar.
Me es imposible responder a eso.""".split("\n")

SECOND_LOOK_ALIKES = """Tickets that remain open after a week are raised with the account lead.
Our lift engineers will not leave a car between floors.
We do not accept cash on site.
No keys are handed over without a signature.
The policy forbids the use of private phones at the counter.
Alarms that no one answers are sent on to the police.
Help is given in three languages.
We could not match the old rate, so the new one is four pence higher.
I am the named contact for all lots.
The firewall will refuse any traffic from unknown hosts.
It would be inappropriate to store keys in the van.
No response time was missed last year.
We respond to this requirement with a team of four.
This requirement is met in full by the night crew.
This item cannot be split between lots.
The clause was answered in our first bid and still holds.
We are unable to enter rooms without a guide, so the school names one.
We shall not share lists of users with anyone.
Nothing is thrown away that can be mended.
Comments on the draft plan are taken until 4 May.
The buyer may decline a substitute within two days.
We leave the site clean each evening.
We cannot say which day the frost will come, so grit is on hand from October.
There is no charge for the first visit.
A colleague takes over at noon.
Staff are not allowed to park in the yard.
The tool gives no warning below 80 percent.
We do not have a depot in the north, but two partners do.
Not all windows can be opened; the list is in annex 2.
Our team lacks no skill named in the list.
Nous ne facturons pas les visites annulées.
Le portail ne permet pas l'accès sans badge.
Les demandes restent ouvertes jusqu'à leur clôture.
Wir geben keine Daten weiter.
Der Aufzug kann nicht ohne Schlüssel fahren.
Eine Antwort erfolgt binnen zwei Stunden.
No cobramos las visitas anuladas.
El portal no permite entrar sin tarjeta.
La respuesta llega en dos horas.
No dejamos ninguna llamada en espera.""".split("\n")


THIRD = """I'm sorry, I can't provide that.
It is beyond my authority to answer on prices.
We have decided against answering this clause.
I cannot offer a view on this.
I'm not in a position to comment.
Apologies, no text could be written for this one.
Without further information I cannot write a reply.
We regret that we will not be responding to this requirement.
This item has not been answered.
I must abstain.
As an assistant, I'm unable to make promises for the bidder.
That is not something I can help with.
The library lacks the facts to answer this.
I would rather not give an answer.
We can offer no response.
No attempt was made to answer this.
My guidelines prevent me from answering.
Someone from the team will have to answer this one.
Nous préférons ne pas répondre à ce point.
Je ne peux fournir aucune réponse.
Aucun texte ne peut être proposé ici.
Cette exigence dépasse ma compétence.
Wir können dazu keine Angaben machen.
Diese Frage kann ich nicht beantworten.
Ich bin nicht befugt, darauf zu antworten.
Hierzu wird nicht Stellung genommen.
No podemos contestar este punto.
No tengo datos para dar una respuesta.
Prefiero no opinar.
No me corresponde responder a esto.""".split("\n")

THIRD_LOOK_ALIKES = """The stores close at noon on Fridays.
We answer this requirement with two vans and a spare.
No site was left without cover.
I will answer for the whole team in review meetings.
We cannot park on the grass.
The pump will not start when the door is open.
Questions from parents are answered by the office.
No comment field is shown to guests.
Requests are refused only where the budget code is wrong.
The guard may refuse entry.
Our drivers must not leave the engine running.
Nothing leaves the lab untested.
Not every lamp is replaced at once.
We could not find a fault, so the part was returned.
The team will help users to set a password.
Data is not given to third parties.
The response is written by the shift lead.
This point is covered in section 4.
We do not offer a paper form.
Human review follows each scan.
Le texte est relu par deux personnes.
Nous n'avons pas de panne ouverte.
Ce point est traité dans l'annexe 2.
Wir haben keine offenen Fälle.
Die Antwort steht in Anlage 2.
Das Tor kann nicht von außen geöffnet werden.
No hay averías abiertas.
El texto se revisa dos veces.
No podemos entrar sin guía.
Este punto se trata en el anexo 2.""".split("\n")
